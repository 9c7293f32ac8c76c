"""Online forms of the rolling statistics: per-key state over a stream, in the order rows arrive."""

from __future__ import annotations

import collections
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "key long, n long, value double, statistic double"
STATE = "n long, recent array<double>"
PIECE = 1 << 18  # rows of a key that are held at a time
ROWS = 1 << 13  # rows that are read or returned at a time


def _statistic(kind: str, window: int, recent: np.ndarray, default: float, u: float, n_mad: float, alpha: float) -> float:
    if kind == "quantile":
        return float(np.quantile(recent, 1 - u)) if len(recent) >= min(10, window) else default
    if kind == "mad":
        med = np.median(recent)
        return float(med + n_mad * 1.4826 * np.median(np.abs(recent - med))) if len(recent) == window else default
    if kind == "mean":
        return float(recent.mean())
    weights = alpha ** np.arange(len(recent))[::-1]
    return float((weights * recent).sum() / weights.sum())


def _spilled(rows: pd.DataFrame) -> Iterator[tuple]:
    """(order, value) of rows that wait in a file of the task's own."""
    with tempfile.TemporaryFile() as f:
        for at in range(0, len(rows), ROWS):
            part = rows.iloc[at : at + ROWS]
            pickle.dump((part["order"].tolist(), part["value"].tolist()), f, 5)
        f.seek(0)
        n, rows, part = -(-len(rows) // ROWS), None, None
        yield ()
        for _ in range(n):
            yield from zip(*pickle.load(f))


def in_order(batches: Iterator[pd.DataFrame], piece: int = PIECE) -> Iterator[float]:
    """The values by ``order``, nulls last. At most about ``piece`` rows are held; more than that is
    sorted in runs, which are written and merged."""
    held, size, runs = [], 0, []
    for b in batches:
        held.append(b[["order", "value"]])
        size += len(b)
        if size >= piece:
            runs.append(_spilled(pd.concat(held).sort_values("order", kind="stable")))
            next(runs[-1])  # writes the run
            held, size = [], 0
    rest = pd.concat(held).sort_values("order", kind="stable") if held else None
    if not runs:
        yield from rest["value"].tolist() if held else ()
        return
    if held:
        runs.append(zip(rest["order"].tolist(), rest["value"].tolist()))
    for _, v in heapq.merge(*runs, key=lambda r: (True, 0) if pd.isna(r[0]) else (False, r[0])):
        yield v


def rolling(stream: DataFrame, kind: str, window: int = 100, default: float = 0.0, u: float = 0.05, n_mad: float = 3.0, alpha: float = 0.95) -> DataFrame:
    """kind: 'quantile', 'mad', 'mean' or 'smooth'. The stream has (key, value, order); rows of a
    micro-batch are taken by ``order``. State is the last ``window`` values of a key; windows count
    rows, so no watermark is needed, and a late row counts when it arrives."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, recent = state.get if state.exists else (0, [])
        recent, out = collections.deque(recent, max(1, window)), []
        frame = lambda: pd.DataFrame(out, columns=["key", "n", "value", "statistic"])
        for v in in_order(batches):
            if len(out) == ROWS:
                yield frame()
                out = []
            n += 1
            recent.append(float(v))
            out.append((int(key[0]), n, float(v), _statistic(kind, window, np.array(recent), default, u, n_mad, alpha)))
        state.update((n, list(recent)))
        yield frame()

    return stream.groupBy("key").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")
