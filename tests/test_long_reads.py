"""Blocked recursions against plain ones, on reads that span several levels of blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from porelake.operators import aligning, blocks, layers, mapping, networks, paths as P
from tests import plain_recursions as K

N = 3


@pytest.fixture(scope="module")
def reads():
    rng = np.random.default_rng(1)
    found = {f"r{k}": rng.normal(size=(k, 2 * N * (N + 1))) for k in (1, 4, 5, 61, 130)}
    found["ties"] = np.zeros((40, 2 * N * (N + 1)))
    return found


@pytest.fixture(scope="module")
def scores(spark, reads):
    rows = [(k, t, [float(v) for v in x]) for k, xs in reads.items() for t, x in enumerate(xs)]
    return spark.createDataFrame(rows, "read_id string, t long, scores array<double>").repartition(5)


def by_read(df, value):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.read_id, r.t)):
        out.setdefault(r.read_id, []).append(r)
    assert all([r.t for r in rs] == list(range(len(rs))) for rs in out.values())
    return {k: np.array([r[value] for r in rs]) for k, rs in out.items()}


@pytest.mark.parametrize("size, fan", [(4, 3), (64, 64)])
def test_sums_of_paths(scores, reads, size, fan):
    b = blocks.Blocks.of(scores, N, size=size, fan=fan)
    ahead, back, post = by_read(b.forward(P.start(N)), "v"), by_read(b.backward(), "v"), by_read(b.posteriors(P.start(N)), "p")
    z = {r.read_id: r for r in b.log_partition(P.start(N)).collect()}
    start = np.where(np.arange(2 * N) < N, 0.0, P.FLOP_START)
    for k, x in reads.items():
        a = K.dense(x)
        assert np.allclose(ahead[k], K.forward(a, start)) and np.allclose(back[k], K.backward(a)) and np.allclose(post[k], K.posterior(x))
        assert np.isclose(z[k].log_z, K.log_partition(x)) and z[k].n == len(x)


@pytest.mark.parametrize("size, fan", [(4, 3), (64, 64)])
def test_best_paths(scores, reads, size, fan):
    found = by_read(blocks.viterbi(scores, N, size=size, fan=fan), "state")
    assert {k: v.tolist() for k, v in found.items()} == {k: K.viterbi(x).tolist() for k, x in reads.items()}


@pytest.mark.parametrize("modified", [False, True])
def test_gradients_are_finite_differences(spark, modified):
    rng = np.random.default_rng(2)
    n, wide = 2, 2 * 2 * 3 + 3
    x = rng.normal(size=(9, wide))
    codes = [0, 1, 3, 1, 0]
    places = (lambda c: F.transform(c, lambda v: (v % 3 + 13).cast("int"))) if modified else None
    factors = (lambda c: F.transform(c, lambda v, i: 0.25 + 0.5 * i)) if modified else None
    frame = lambda xs: spark.createDataFrame([(k, [[float(v) for v in s] for s in m], codes) for k, m in enumerate(xs)], "read_id long, steps array<array<double>>, codes array<int>")
    got = np.array([r.g for r in blocks.gradient_rows(frame([x]), n, size=4, entered=places, weights=factors).orderBy("t").collect()])
    shifted = []
    for t in range(9):
        for j in range(wide):
            for d in (1e-5, -1e-5):
                y = x.copy()
                y[t, j] += d
                shifted.append(y)
    more = {} if not modified else {"entered": places(F.col("codes")), "weights": factors(F.col("codes"))}
    cost = [r.c for r in frame(shifted).select("read_id", P.sequence_cost(F.col("steps"), n, F.col("codes"), **more).alias("c")).orderBy("read_id").collect()]
    want = (np.array(cost[::2]) - np.array(cost[1::2])).reshape(9, wide) / 2e-5
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-8)


@pytest.mark.parametrize("kind, reverse", [("gru", False), ("lstm", True)])
def test_recurrent_layers_in_parts(spark, kind, reverse):
    rng = np.random.default_rng(3)
    gates = 3 if kind == "gru" else 4
    w = [rng.normal(size=s) for s in ((gates * 2, 3), (gates * 2, 2), (gates * 2,))]
    rows = [(r, t, [float(v) for v in rng.normal(size=3)]) for r, m in ((0, 1), (1, 7), (2, 30)) for t in range(m)]
    df = spark.createDataFrame(rows, "read_id long, t long, x array<double>")
    whole, parts = (sorted(layers.recurrent(df, kind, 2, *w, reverse=reverse, part=p).collect()) for p in (1000, 4))
    assert len(whole) == 38 and all(a[:2] == b[:2] and np.allclose(a.x, b.x) for a, b in zip(whole, parts))


def test_clipped_path_at_stride_two(spark):
    """A published vector: a skipped base shares the next one's sample, clipped ends lie outside."""
    path = [-1, -1, 1, 1, 2, 2, 2, 4, 4, 4, 5, 5, 6, 7, -1, -1]
    df = spark.createDataFrame([("r", k, p, 0, 30) for k, p in enumerate(path)], "read_id string, k int, ref int, trim_start int, siglen int")
    reads = spark.createDataFrame([("r", 10, 30)], "read_id string, reflen int, siglen int")
    mapped = mapping.path_to_signal(df, 2, ["read_id"])
    assert [r.loc for r in mapping.invert(mapped, reads).orderBy("r").collect()] == [-1, 3, 7, 13, 13, 19, 23, 25, 26, 31, 31]


def as_rows(spark, reads, codes):
    rows = [(k, [[float(v) for v in x] for x in xs], [int(c) for c in codes[k]]) for k, xs in reads.items()]
    return spark.createDataFrame(rows, "read_id string, steps array<array<double>>, codes array<int>")


@pytest.mark.parametrize("size, pen", [(4, 1.0), (4, -0.5), (64, 0.3)])
def test_remap(spark, reads, size, pen):
    rng = np.random.default_rng(7)
    codes = {k: K.flipflop_codes(rng.integers(0, N, max(2, len(x) // 3)), N) for k, x in reads.items()}
    path, score = aligning.remap(as_rows(spark, reads, codes), N, pen, size=size)
    found, scores = by_read(path, "position"), {r.read_id: r.score for r in score.collect()}
    for k, x in reads.items():
        want, positions = K.remap(x, codes[k], pen)
        assert np.isclose(scores[k], want) and found[k].tolist() == positions.tolist()


def test_remap_vectors(spark):
    """Published vectors: a global alignment, and one clipped at both ends."""
    m = np.zeros((6, 12))
    m[range(6), [8, 10, 6, 5, 1, 0]] = 1
    c = np.zeros((5, 12))
    c[2, 5] = c[3, 1] = 1
    path, score = aligning.remap(as_rows(spark, {"a": m, "b": c}, {"a": [0, 2, 1, 0], "b": [1, 0]}), 2, -0.5, size=2)
    assert {k: v.tolist() for k, v in by_read(path, "position").items()} == {"a": [0, 1, 1, 2, 2, 3, 3], "b": [-1, -1, 0, 0, 1, -1]}
    assert {r.read_id: r.score for r in score.collect()} == {"a": 6.0, "b": 3.5}


def plain_squiggle(signal, params, back):
    """-log density, by a table of all states."""
    loc, sd, rate = params.T
    n, move = len(loc), (1 - back) / (1 + np.exp(-rate))
    step = np.zeros((2 * n, 2 * n))  # to, from
    for p in range(n):
        step[p, p], step[n + p, n + p] = 1 - move[p] - back, 0.5
        if p:
            step[p, p - 1], step[n + p - 1, p], step[p, n + p - 1] = move[p], back, 0.5
    at = np.eye(2 * n)[0]
    for x in signal:
        at = (step @ at) * np.tile(np.exp(-np.log(2) - sd - np.abs(x - loc) * np.exp(-sd)), 2)
    return -np.log(at[n - 1])


def plain_squiggle_path(signal, params, pen, back, least):
    """Best score and path over all sequences of states, for a few samples and levels."""
    loc, sd, rate = params.T
    n, move = len(loc), np.log((1 - back) / (1 + np.exp(-rate)))
    stay = np.log(1 - np.exp(move) - back)
    best = (-np.inf, None)

    def ways(s):  # states: -1 before, positions, n after, ("back", p)
        if s == -1:
            yield -1, stay.mean()
            yield from ((p, move.mean() - pen * p) for p in range(n))
        elif s == n:
            yield n, stay.mean()
        elif isinstance(s, tuple):
            yield s, np.log(0.5)
            if s[1] + 1 < n:
                yield s[1] + 1, np.log(0.5)
        else:
            yield s, stay[s]
            if s + 1 < n:
                yield s + 1, move[s]
            yield n, move[s] - pen * (n - 1 - s)
            if s:
                yield ("back", s - 1), np.log(back)

    def go(s, t, score, path):
        nonlocal best
        if t == len(signal):
            if s in (n - 1, n) and score > best[0] + 1e-12:
                best = (score, path)
            return
        for to, w in ways(s):
            p = to[1] if isinstance(to, tuple) else to
            e = -pen if to in (-1, n) else max(-least, -np.log(2) - sd[p] - abs(signal[t] - loc[p]) * np.exp(-sd[p]))
            go(to, t + 1, score + w + e, [*path, -1 if to in (-1, n) else p])

    go(-1, 0, 0.0, [])
    return best


@pytest.fixture(scope="module")
def squiggles(spark):
    rng = np.random.default_rng(8)
    signals = {f"r{k}": rng.normal(size=k) * 2 for k in (1, 2, 5, 6, 40)}
    levels = {k: rng.normal(size=(max(1, min(3, len(x) // 2)), 3)) for k, x in signals.items()}
    rows = [(k, [float(v) for v in x], [tuple(map(float, p)) for p in levels[k]]) for k, x in signals.items()]
    return signals, levels, spark.createDataFrame(rows, "read_id string, signal array<double>, levels array<struct<location:double,logsd:double,rate:double>>")


def test_squiggle_costs_and_gradients(squiggles):
    signals, levels, df = squiggles
    costs = {r.read_id: r.c for r in df.select("read_id", aligning.squiggle_cost(F.col("signal"), F.col("levels"), 0.05).alias("c")).collect()}
    found = {(r.read_id, r.pos): (r.location, r.logsd, r.rate) for r in aligning.squiggle_gradient(df, 0.05, size=4).collect()}
    for k, x in signals.items():
        assert np.isclose(costs[k], plain_squiggle(x, levels[k], 0.05))
        for p in range(len(levels[k])):
            for c in range(3):
                moved = [levels[k] + d * (np.arange(levels[k].size).reshape(-1, 3) == 3 * p + c) for d in (1e-6, -1e-6)]
                want = (plain_squiggle(x, moved[0], 0.05) - plain_squiggle(x, moved[1], 0.05)) / 2e-6
                assert found[k, p][c] == pytest.approx(want, abs=1e-6), (k, p, c)


@pytest.mark.parametrize("pen, back, least", [(0.7, 0.1, 1e30), (0.0, 1e-15, 2.5), (3.0, 0.3, 4.0)])
def test_squiggle_paths(squiggles, pen, back, least):
    signals, levels, df = squiggles
    path, score = aligning.squiggle_path(df.where("size(signal) < 7"), pen, back, least, size=4)
    found, scores = by_read(path, "pos"), {r.read_id: r.score for r in score.collect()}
    for k, x in signals.items():
        if len(x) < 7:
            want, positions = plain_squiggle_path(x, levels[k], pen, back, least)
            assert np.isclose(scores[k], want)
            if pen:  # without a penalty paths tie
                assert found[k].tolist() == positions


def test_squiggle_paths_do_not_hang_on_the_blocks(squiggles):
    _, _, df = squiggles
    small, large = (sorted(map(tuple, aligning.squiggle_path(df, 1.0, 0.01, size=s)[0].collect())) for s in (3, 64))
    assert small == large and len(small) == 54


@pytest.mark.parametrize("width, guided", [(1, True), (4, True), (3, False), (50, False)])
def test_beams(spark, reads, width, guided):
    df = as_rows(spark, {k: v for k, v in reads.items() if k != "ties" and len(v) < 100}, dict.fromkeys(reads, [0]))
    back = P.backward(F.col("steps"), N) if guided else None
    for r in df.select("read_id", P.beam_search(F.col("steps"), N, back, width).alias("b")).collect():
        score, states = K.beam_search(reads[r.read_id], width, guided)
        assert np.isclose(r.b.w, score) and tuple(r.b.p) == states


def test_beams_merge_paths_of_one_sequence(spark):
    """With room for every prefix the best one's weight is the sum over all its paths."""
    x = np.random.default_rng(5).normal(size=(4, 12))
    r = as_rows(spark, {"a": x}, {"a": [0]}).select(P.beam_search(F.col("steps"), 2, None, 10_000).alias("b")).first().b
    a, total = K.dense(x), {}
    for states in np.ndindex(*[4] * 5):
        w = sum(a[t, states[t + 1], states[t]] for t in range(4))
        if w > -1e20:
            key = tuple(s for k, s in enumerate(states) if k == 0 or s != states[k - 1])
            total[key] = np.logaddexp(total.get(key, -np.inf), w)
    best = max(total, key=lambda p: (total[p], p))
    assert tuple(r.p) == best and np.isclose(r.w, total[best])


@pytest.mark.parametrize("mods", [None, [0, 2]])
@pytest.mark.parametrize("kind", [networks.gru_flipflop, networks.lstm_flipflop])
def test_architectures(spark, kind, mods):
    """Shapes of the heads; weights of all paths sum to 1 after normalising; modifications to 1 with their base."""
    rng = np.random.default_rng(6)
    net = kind(lambda *shape: rng.normal(size=shape) * 0.5, size=4, winlen=3, n=2, mods=mods)
    df = spark.createDataFrame([(r, t, [float(rng.normal())]) for r, m in ((0, 3), (1, 40)) for t in range(m)], "read_id long, t long, x array<double>")
    rows = net.normalised(df).collect()
    stride = 2 if kind is networks.gru_flipflop else 5
    assert sorted((r.read_id, r.t) for r in rows) == [(r, t) for r, m in ((0, 3), (1, 40)) for t in range(-(-m // stride))]
    for read in (0, 1):
        x = np.array([r.x for r in sorted(rows, key=lambda r: r.t) if r.read_id == read])
        assert x.shape[1] == 12 + (4 if mods else 0) and K.log_partition(x[:, :12]) == pytest.approx(0, abs=1e-9)
        if mods:
            assert np.allclose(x[:, 12], 0) and np.allclose(np.exp(x[:, 13:]).sum(1), 1)


def test_beams_are_cut(spark, reads):
    """A cut wide enough changes nothing, one near zero leaves the best sequence of each step alone."""
    df = as_rows(spark, {k: reads[k] for k in ("r4", "r61")}, dict.fromkeys(reads, [0]))
    search = lambda width, cut: P.beam_search(F.col("steps"), N, P.backward(F.col("steps"), N), width, cut)
    for r in df.select(search(5, 1e9).alias("wide"), search(5, 0.0).alias("none"), search(5, 1e-12).alias("near"), search(1, 0.0).alias("one"), search(5, 2.0).alias("some")).collect():
        assert r.wide == r.none and r.near == r.one and r.one.w <= r.some.w <= r.none.w + 1e-9
