"""Hand-computed values, and invariants of the dynamic programs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from porelake.functions import activation, qscore, sequence
from porelake.operators import alphabets, chunks, joins, layers, mapping, paths, robust, rolling, runs, scans
from tests import plain_recursions as K


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy(*cols).collect()]


def test_flipflop_code(spark):
    labels = [1, 3, 2, 3, 3, 3, 3, 1, 1]
    df = spark.createDataFrame([(0, t, x) for t, x in enumerate(labels)], "read_id long, t long, label int")
    got = runs.flipflop_code(df, "label", 4, ["read_id"]).orderBy("t").collect()
    assert [r.code for r in got] == [1, 3, 2, 3, 7, 3, 7, 1, 5]
    assert K.flipflop_codes(np.array(labels), 4).tolist() == [1, 3, 2, 3, 7, 3, 7, 1, 5]


def test_runs_open_at_jumps(spark):
    df = spark.createDataFrame([(0, t, x) for t, x in enumerate([1.0, 1.4, 1.9, 5.0, 5.1])], "read_id long, t long, v double")
    got = rows(runs.run_lengths(df, "v", ["read_id"], tol=1.0).select("start", "value", "length"), "start")
    assert got == [(0, 1.0, 3), (3, 5.0, 2)]  # neighbours are compared, so slow drift opens no run


def test_path_to_sequence(spark):
    df = spark.createDataFrame([(0, t, s) for t, s in enumerate([1, 0, 2, 2, 1, 1, 0, 0])], "read_id long, t long, state int")
    assert runs.path_to_sequence(df, "state", "ACGT", ["read_id"]).first().seq == "CAGCA"
    assert runs.path_to_sequence(df, "state", "ACGT", ["read_id"], with_first=False).first().seq == "AGCA"


def test_remap_goldens():
    m = np.zeros((6, 12))
    for t, c in enumerate([8, 10, 6, 5, 1, 0]):
        m[t, c] = 1
    codes = K.flipflop_codes(np.array([0, 0, 1, 0]), 2)
    step, stay = K.sequence_indices(codes, 2)
    assert (step.tolist(), stay.tolist()) == ([8, 6, 1], [0, 10, 5, 0])
    score, path = K.remap(m, codes, -0.5)
    assert (score, path.tolist()) == (6.0, [0, 1, 1, 2, 2, 3, 3])
    m = np.zeros((5, 12))
    m[2, 5] = m[3, 1] = 1
    score, path = K.remap(m, np.array([1, 0]), -0.5)
    assert (score, path.tolist()) == (3.5, [-1, -1, 0, 0, 1, -1])


def test_forward_golden():
    x = np.random.RandomState(0xDEADBEEF).randn(12, 40).astype("f4")
    assert K.log_partition(x, free_start=True) == pytest.approx(27.168769, abs=1e-5)


def test_invariants():
    x = np.random.RandomState(1).randn(15, 40)
    a = K.dense(x)
    f, b = K.forward(a, np.zeros(8)), K.backward(a)
    assert np.allclose(K.lse(f + b, 1), K.lse(f[-1], 0))
    assert np.allclose(K.posterior(x).sum(1), 1)
    assert np.allclose(K.undense(a), x)
    assert K.log_partition(x - K.log_partition(x) / len(x)) == pytest.approx(0, abs=1e-9)
    path = K.viterbi(x)
    best = sum(a[t, path[t + 1], path[t]] for t in range(len(x)))
    assert path[0] < 4 and best <= K.log_partition(x)


def test_cost_is_log_of_summed_paths():
    x, codes = np.random.RandomState(2).randn(4, 12), np.array([0, 1])
    step, stay = K.sequence_indices(codes, 2)
    total = sum(np.exp(sum(x[t, stay[0]] for t in range(k)) + x[k, step[0]] + sum(x[t, stay[1]] for t in range(k + 1, 4))) for k in range(4))
    assert K.sequence_cost(x, codes) == pytest.approx(-np.log(total) / 4)
    g, eps = K.sequence_gradient(x, codes), 1e-6
    for t, s in ((0, stay[0]), (2, step[0]), (3, stay[1])):
        up, down = x.copy(), x.copy()
        up[t, s] += eps
        down[t, s] -= eps
        assert g[t, s] == pytest.approx((K.sequence_cost(up, codes) - K.sequence_cost(down, codes)) / (2 * eps), abs=1e-5)


def test_ctc_and_beam():
    lp = np.log(np.full((3, 3), 1 / 3))
    assert K.ctc_cost(lp, np.array([0]), 2) == pytest.approx(-np.log(6 / 27) / 3)  # six of 27 paths spell it
    x = np.random.RandomState(3).randn(6, 12) * 5
    score, states = K.beam_search(x, width=500)
    assert score <= K.log_partition(x, free_start=True)
    assert all(a != b for a, b in zip(states, states[1:]))


def test_squiggle_path_follows_levels():
    params = np.array([[0.0, -1, 0], [10, -1, 0], [20, -1, 0]])
    signal = np.array([0.1, -0.1, 9.8, 10.2, 10.1, 20.0, 19.9])
    score, path = K.squiggle_path(signal, params, 1.0)
    assert path.tolist() == [0, 0, 1, 1, 1, 2, 2]
    assert K.squiggle_cost(signal, params) <= -score + 1e-9


def test_ref_to_signal_goldens(spark):
    for stride, path, siglen, reflen, want in (
        (1, [-1, 0, 0, 1, 1, 1, 3, 3, 3, 4, 4, 5, 6], 12, 7, [0, 2, 5, 5, 8, 10, 11, 12]),
        (1, [-1, -1, 1, 1, 2, 2, 2, 4, 4, 4, 5, 5, 6, 7, -1, -1], 15, 10, [-1, 1, 3, 6, 6, 9, 11, 12, 13, 16, 16]),
        (2, [-1, 0, 0, 1, 1, 1, 3, 3, 3, 4, 4, 5, 6], 24, 7, [1, 5, 11, 11, 17, 21, 23, 24]),
    ):
        rows_ = [(0, k, r, 0, siglen) for k, r in enumerate(path)]
        df = spark.createDataFrame(rows_, "read_id long, k long, ref int, trim_start int, siglen int")
        mapped = mapping.path_to_signal(df, stride, ["read_id"])
        reads = spark.createDataFrame([(0, reflen, siglen)], "read_id long, reflen int, siglen int")
        got = [r.loc for r in mapping.invert(mapped, reads).orderBy("r").collect()]
        assert got == want, (stride, got)


def test_mapping_check_and_chunk(spark):
    r2s = [-1, -1, 2, 3, 4, 5, 5, 5, 5, 7, 8, 9, 10, 20, 20, 20, 20]
    df = spark.createDataFrame([("a", list(range(20)), r2s, [0] * 16), ("b", list(range(20)), r2s, [0] * 15)], "read_id string, dacs array<int>, ref_to_signal array<int>, reference array<int>")
    said = {r.read_id: r.m for r in df.select("read_id", mapping.check(F.col("reference"), F.col("ref_to_signal"), F.size("dacs")).alias("m")).collect()}
    assert said["a"] == "pass" and "length" in said["b"]
    c = chunks.fixed_samples(df.where("read_id = 'a'"), 5, F.lit(3)).first()
    assert (c.sig_len, c.start_sample, c.reject_reason) == (5, 5, None)


def test_med_mad(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 1.0), (1, 3.0), (2, None)], "k int, v double")
    got = {r.k: (r.med, r.mad) for r in robust.med_mad(df, "v", ["k"], 1.0).collect()}
    assert got == {1: (1.0, 0.5), 2: (None, None)}


def test_trim(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], 1, 1), ([1, 2], 1, 1), ([1, 2], -1, 0)], "x array<int>, a int, b int")
    assert [r[0] for r in df.select(robust.trim(F.col("x"), F.col("a"), F.col("b"))).collect()] == [[2, 3], [1, 2], None]


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTN-",), ("acgZ",)], "s string")
    assert [r[0] for r in df.select(sequence.reverse_complement(F.col("s"))).collect()] == ["-NACGT", None]
    assert [r[0] for r in df.select(sequence.encode(F.col("s"), "ACGTN-")).collect()] == [[0, 1, 2, 3, 4, 5], None]
    m = spark.createDataFrame([("3S10M2I4D10M",), ("*",)], "c string")
    assert [tuple(r) for r in m.select(*[sequence.cigar_total(F.col("c"), o) for o in "MIDS"]).collect()] == [(20, 2, 4, 3), (0, 0, 0, 0)]


def test_qscores(spark):
    df = spark.createDataFrame([(0.1,), (0.0,)], "p double")
    assert [r[0] for r in df.select(qscore.from_error(F.col("p"), 60.0)).collect()] == [pytest.approx(10), 60.0]
    assert [r[0] for r in spark.createDataFrame([(10.4,), (10.5,)], "q double").select(qscore.to_char(F.col("q"))).collect()] == ["+", ","]
    assert df.select(qscore.transitions_into(F.lit(1), 4)).first()[0] == [*range(8, 16), 33, 37]


def test_state_counts(spark):
    df = spark.createDataFrame([(40,), (41,)], "s int")
    assert [r[0] for r in df.select(activation.base_count(F.col("s"))).collect()] == [4, None]


def test_best_by_skips_nan(spark):
    df = spark.createDataFrame([(1, 0, float("nan")), (1, 1, 0.5), (1, 2, 0.5), (2, 0, None)], "k int, t int, v double")
    assert rows(joins.best_by(df, ["k"], "v", "t").select("k", "t"), "k") == [(1, 1), (2, 0)]


def test_first_file_wins_and_strand_lists(spark):
    a, b = (spark.createDataFrame([(i, n) for i in ids], "read_id int, f string") for ids, n in (((1, 2), "a"), ((2, 3), "b")))
    assert rows(joins.first_file_wins([a, b]).select("read_id", "f"), "read_id") == [(1, "a"), (2, "a"), (3, "b")]
    with pytest.raises(ValueError):
        joins.select_reads(a, spark.createDataFrame([(1,)], "x int"))


def test_rolling_default_until_full(spark):
    df = spark.createDataFrame([(0, t, float(t)) for t in range(5)], "k int, t int, v double")
    got = [r[0] for r in df.select("t", rolling.rolling_mad_threshold(F.col("v"), 0.0, ["k"], "t", window=3, default=-1.0).alias("x")).orderBy("t").select("x").collect()]
    assert got == [-1.0, -1.0, 1.0, 2.0, 3.0]


def test_recurrent_reverse_equals_reversed(spark):
    w = lambda *s: np.sin(np.arange(np.prod(s))).reshape(s)
    df = spark.createDataFrame([(0, t, [float(t), 1.0]) for t in range(6)], "read_id long, t long, x array<double>")
    a = layers.recurrent(df, "gru", 3, w(9, 2), w(9, 3), w(9), reverse=True).orderBy("t").collect()
    b = layers.reverse_time(layers.recurrent(layers.reverse_time(df), "gru", 3, w(9, 2), w(9, 3), w(9))).orderBy("t").collect()
    assert np.allclose([r.x for r in a], [r.x for r in b])


@pytest.mark.parametrize("n,length", [(4, 1), (4, 13), (2, 30)])
def test_paths_equal_the_kernels(spark, n, length):
    """Array functions of the engine against the recursions in numpy."""
    rng = np.random.default_rng(n * 100 + length)
    x = rng.normal(size=(length, 2 * n * (n + 1)))
    codes = K.flipflop_codes(rng.integers(0, n, max(1, length // 2)), n)
    df = paths.steps_of(spark.createDataFrame([(0, t, v.tolist()) for t, v in enumerate(x)], "read_id long, t long, scores array<double>").repartition(3))
    steps = F.col("steps")
    df = df.select("steps", paths.forward(steps, n, paths.start(n)).alias("f"), paths.backward(steps, n).alias("b"), paths.log_partition(steps, n, paths.start(n)).alias("z"), paths.viterbi(steps, n).alias("path"), paths.sequence_cost(steps, n, F.array(*map(F.lit, codes.tolist())), 0.7).alias("cost"))
    df = df.withColumn("post", paths.posterior(steps, n, F.col("f"), F.col("b"), F.col("z"))).withColumn("err", paths.error_probs(F.col("post"), n, F.col("path")))
    r = df.first()
    a = K.dense(x)
    start = np.where(np.arange(2 * n) < n, 0.0, K.FLOP_START)
    assert np.allclose(r.f, K.forward(a, start)) and np.allclose(r.b, K.backward(a)) and np.isclose(r.z, K.log_partition(x))
    assert r.path == K.viterbi(x).tolist() and np.isclose(r.cost, K.sequence_cost(x, codes, 0.7))
    assert np.allclose(r.post, K.posterior(x)) and np.allclose(r.err, K.error_probs(K.posterior(x), K.viterbi(x))[1:])


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    qs = [0.0, 0.05, 0.5, 0.95, 1.0]
    for v in (rng.normal(size=5000), np.repeat([1.0, 2.0, 1e9], [4000, 10, 1]), np.concatenate([rng.normal(size=2000) * 1e-12 + 1, [1e12]]), np.array([3.0])):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
        for bins, most in ((7, 5), (4096, 65536)):
            assert np.allclose(robust.exact_quantiles(df, F.col("v"), qs, bins, most), np.quantile(v, qs), rtol=1e-12)
    assert robust.exact_quantiles(df.where("v > 9"), F.col("v"), [0.5]) == [None]


def test_unsound_alphabets(spark):
    rows_ = [("a", 0, "A", "A", None), ("a", 1, "Z", "A", "z"), ("b", 0, "A", "A", None), ("b", 1, "A", "A", None), ("c", 0, "Z", "A", "z"), ("d", 0, "A", "A", None), ("d", 1, "Y", "A", None)]
    df = spark.createDataFrame(rows_, "file string, position int, base string, canonical string, long_name string")
    assert {r.file: r.message for r in alphabets.faults(df).collect()} == {"b": "a base occurs twice", "c": "a canonical base is not in the alphabet", "d": "a modified base has no long name"}
    assert alphabets.all_equal(df.where("file = 'a'")).first().equal and not alphabets.all_equal(df).first().equal


def test_limited_merge_takes_new_reads(spark):
    """Files that overlap wholly still give the limit's number of reads, as far as there are new ones."""
    files = [spark.createDataFrame([(i, n) for i in range(top)], "read_id int, f string") for top, n in ((10, "a"), (10, "b"), (12, "c"))]
    got = joins.first_file_wins(files, limit=4).collect()
    assert len(got) == len({r.read_id for r in got}) == 12


def test_quantiles_of_groups(spark):
    """Infinities, zeros of both signs, NaN, nulls, ties, null groups, and more rows than are counted by value."""
    rng = np.random.default_rng(5)
    inf = float("inf")
    qs = [0.0, 0.05, 0.3, 0.5, 0.95, 1.0]
    groups = {"a": rng.normal(size=900), "b": np.array([-inf, 1.0, 2.0, inf, inf]), None: rng.integers(-3, 3, 400).astype(float), "d": np.repeat([1.0, -inf], [70, 30]), "e": np.array([7.0]), "f": rng.normal(size=300) * 1e-300, "g": np.array([-0.0, 0.0, 5e-324, -5e-324])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("a", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    for most in (4, 65_536):
        found = {r.k: r for r in robust.quantiles(df, F.col("v"), qs, ["k"], most).collect()}
        assert set(found) == set(groups)
        for k, v in groups.items():
            v, r = np.sort(v), found[k]
            at = [q * (len(v) - 1) for q in qs]
            want = [v[int(p)] if v[int(p)] == v[min(int(p) + 1, len(v) - 1)] or p == int(p) else v[int(p)] + (p - int(p)) * (v[int(p) + 1] - v[int(p)]) for p in at]
            assert r.n == len(v) and np.allclose(r.quantiles, want, rtol=1e-12, equal_nan=True), (k, r, want)
    assert robust.exact_quantiles(df.where("k = 'b'"), F.col("v"), [0.5, 0.99], most=2) == [2.0, inf]
    assert robust.exact_quantiles(spark.createDataFrame([(float(i % 50),) for i in range(100)] + [(inf,)], "v double"), F.col("v"), [0.5, 1.0], 4, 8) == [25.0, inf]


def test_scans_are_windows(spark):
    """Places, running totals and as-of lookups in small bins equal plain ones."""
    rnd = random.Random(6)
    rows = [(g, rnd.randrange(-500, 5000), k) for k in range(600) for g in ("a", "b")] + [("c", 7, 0)]
    df = spark.createDataFrame(rows, "g string, at long, tie int")
    got = {(r.g, r.at, r.tie): r.place for r in scans.numbered(df, ["g"], "at", 10, ties=["tie"]).collect()}
    for g in "abc":
        assert [got[x] for x in sorted(x for x in got if x[0] == g)] == list(range(sum(r[0] == g for r in rows)))
    bins = [(g, b, rnd.randrange(100)) for g in "ab" for b in rnd.sample(range(-300, 90_000), 200)]
    frame = spark.createDataFrame(bins, "g string, bin long, v long")
    for how, of in ((F.sum, sum), (F.max, max)):
        for r in scans.carried(frame, ["g"], "bin", "v", how, fan=7).collect():
            before = [v for g, b, v in bins if g == r.g and b < r.bin]
            assert r.carry == (of(before) if before else None)
    bases = [(g, loc, i) for g in "ab" for i, loc in enumerate(sorted(rnd.randrange(10_000) for _ in range(50)))]
    points = [(g, rnd.randrange(-10, 11_000)) for g in "abz" for _ in range(100)]
    met = scans.as_of(spark.createDataFrame(points, "g string, p long"), spark.createDataFrame(bases, "g string, loc long, i long"), ["g"], "p", "loc", "i", "found", width=16)
    want = sorted((g, p, max((i for h, loc, i in bases if h == g and loc <= p), default=None)) for g, p in points)
    assert sorted(map(tuple, met.collect()), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_intervals_outside_the_map(spark):
    """Row form against the array form; an entry of -1 or beyond the signal is not mapped."""
    r2s, siglen = [-1, -1, 10, 10, 14, 20, 31, 31], 30
    bases = spark.createDataFrame([("r", i, v) for i, v in enumerate(r2s)] + [("none", 0, -1), ("none", 1, 31)], "read_id string, i long, loc long")
    reads = spark.createDataFrame([("r", siglen), ("none", siglen)], "read_id string, siglen long")
    asked = [("r", a, b) for a in range(8, 23) for b in range(a, 23)] + [("none", 0, 0), ("none", 0, 5)]
    found = mapping.reference_intervals(spark.createDataFrame(asked, "read_id string, start long, end long"), bases, reads, width=4)
    for r in found.collect():
        if r.read_id == "none":
            assert (r.error is None) == (r.end == 0)
        elif r.start < 10 or r.end > 20:
            assert r.first is None and r.last is None and r.error == ("before the mapped region" if r.start < 10 else "after the mapped region")
        else:
            assert (r.first, r.last, r.error) == (np.searchsorted(r2s, r.start, "right") - 1, np.searchsorted(r2s, r.end, "left"), None)


def test_erf_is_exact(spark):
    import math

    xs = [0.0, -0.0, 1e-300, 1e-9, 0.1, -0.5, 1.0, 2.0, -3.0, 4.5, 5.999, 6.0, -7.0, 1e300, float("inf"), -float("inf"), *np.random.default_rng(1).normal(size=300) * 3]
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,), (float("nan"),)], "x double")
    got = [r.y for r in df.select(activation.erf(F.col("x")).alias("y")).collect()]
    assert got[-2:] == [None, None] and np.allclose(got[:-2], [math.erf(x) for x in xs], rtol=1e-14, atol=0)
