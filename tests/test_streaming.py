"""The stream's rows go to shared files, and a key's rows are stepped through in bounded pieces."""

import collections

import numpy as np
import pandas as pd
import pytest

from porelake import catalog
from porelake.streaming import rolling


def test_result_lies_in_shared_files(spark, sf_dir):
    df = catalog.queries()["stream_rolling_mean"](spark, sf_dir)
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    files = df.inputFiles()
    assert files and all(shared in f for f in files)
    recent, want = collections.defaultdict(list), []
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect():
        recent[r.user_id].append(r.value)
        want.append((r.user_id, len(recent[r.user_id]), r.value, round(float(np.mean(recent[r.user_id][-10:])), 9)))
    assert sorted((r.key, r.n, r.value, round(r.statistic, 9)) for r in df.collect()) == sorted(want)


@pytest.mark.parametrize("piece", [1, 100, 5000, 10**6])
def test_pieces_are_in_order(piece):
    rng = np.random.default_rng(3)
    order = rng.permutation(30_000)
    rows = pd.DataFrame({"key": 1, "value": order * 0.5, "order": order})
    batches = (rows.iloc[at : at + 700] for at in range(0, len(rows), 700))
    assert list(rolling.in_order(batches, piece)) == [0.5 * k for k in range(30_000)]
    assert list(rolling.in_order(iter(()), piece)) == []


def test_steps_are_bounded():
    """A key's rows come out in frames of a bounded size, with one state."""
    import types

    made = {}
    stream = types.SimpleNamespace(groupBy=lambda _: types.SimpleNamespace(applyInPandasWithState=lambda f, *_: made.update(step=f)))
    rolling.rolling(stream, "mean", window=3)
    kept = []
    state = types.SimpleNamespace(exists=False, update=kept.append)
    n = 3 * rolling.ROWS
    rows = pd.DataFrame({"value": np.arange(n) * 1.0, "order": np.arange(n)})
    frames = list(made["step"]((7,), iter([rows.iloc[n // 2 :], rows.iloc[: n // 2]]), state))
    assert max(map(len, frames)) <= rolling.ROWS and sum(map(len, frames)) == n
    assert frames[-1]["statistic"].iloc[-1] == n - 2 and kept == [(n, [n - 3.0, n - 2.0, n - 1.0])]
