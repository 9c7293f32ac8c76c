"""The pipeline's near-duplicate stage against brute force at similarity 0.8."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from porelake.llm import shingle_dedup, simhash_dedup
from tests.llm.test_exact import WORD


def brute_classes(texts, words_in=5, similarity=0.8):
    """(class of each text, pairs at the similarity)"""
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({" ".join(w[i : i + words_in]) for i in range(max(1, len(w) - words_in + 1))} if w else set())
    root, pairs = list(range(len(sets))), set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(sets)):
        for i in range(j):
            if sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9):
                pairs.add((i, j))
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(sets))], pairs


@pytest.fixture(scope="module")
def edited(words):
    """Texts with 1 to 6 edited copies on both sides of the limit, one large group of near copies,
    and texts that share half of their words."""
    rnd = random.Random(11)
    text = lambda n: [rnd.choice(words) for _ in range(n)]

    def edit(w, n):
        w = list(w)
        for at in rnd.sample(range(len(w)), n):
            w[at] = f"edit{rnd.randrange(10**6)}"
        return " ".join(w)

    rows = []
    for _ in range(60):
        base = text(120)
        rows += [" ".join(base)] + [edit(base, n) for n in range(1, 6)]
    hot = text(150)
    rows += [edit(hot, rnd.randrange(1, 5)) for _ in range(90)]
    half = text(70)
    rows += [" ".join(half + text(rnd.randrange(20, 60))) for _ in range(40)]
    rows += [None, "", "a b", "A  b", rows[0], rows[0].upper()]
    rnd.shuffle(rows)
    return rows


def test_stage_finds_all_at_similarity(spark, make_docs, edited, tmp_path):
    want, pairs = brute_classes(edited)
    docs = make_docs(list(enumerate(edited)))
    found = corpus_pipeline.near_duplicates(spark, docs.repartition(7), str(tmp_path))
    assert len(pairs) > 500
    assert sorted(r.doc_id for r in found.collect()) == sorted(set(want))


@pytest.mark.parametrize("rounds,tile", [(1, 1 << 19), (1, 2000), (3, 100)])
def test_open_buckets_are_settled(spark, edited, monkeypatch, rounds, tile):
    """All texts in one bucket: every pair has to be compared, whatever the number of rounds and
    tiles; of 100 shingles, most tiles hold one text or none."""
    monkeypatch.setattr(shingle_dedup, "TILE", tile)
    texts = [t for t in edited if t][:150]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    keyed = spark.createDataFrame([(i, len(shingle_dedup.shingle_set(t, 5)), 1) for i, t in enumerate(texts)], "id long, n int, bucket long")
    fps = spark.createDataFrame([(i, len(shingle_dedup.shingle_set(t, 5)), shingle_dedup.fingerprint(shingle_dedup.shingle_set(t, 5)).tolist()) for i, t in enumerate(texts)], "id long, n int, fp array<long>")
    root = {r.id: r.root for r in shingle_dedup.roots_of(keyed, fps, df, 5, 0.8, rounds).collect()}
    assert [root.get(i, i) for i in range(len(texts))] == brute_classes(texts)[0]


def test_bands_reach_the_recall(edited):
    keys = [set(shingle_dedup.band_keys(s, 24, 5).tolist()) if len(s := shingle_dedup.shingle_set(t, 5)) else {0} for t in edited]
    _, pairs = brute_classes(edited)
    assert sum(bool(keys[i] & keys[j]) for i, j in pairs) >= 0.999 * len(pairs)


def test_radius_holds_all_pairs(edited):
    """Pairs at the similarity are well inside the radius, texts of few words too."""
    short = [" ".join(f"w{k}" for k in range(n)) for n in range(8, 30)]
    texts = [*edited, *short]
    sets = [shingle_dedup.shingle_set(t, 5) for t in texts]
    fps = [shingle_dedup.fingerprint(s).view(np.uint64) for s in sets]
    _, pairs = brute_classes(texts)
    off = lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j]).sum())
    many = {(i, j) for i, j in pairs if min(len(sets[i]), len(sets[j])) >= shingle_dedup.MANY}
    assert max(off(i, j) for i, j in many) <= shingle_dedup.NARROW - 15
    assert max(off(i, j) for i, j in pairs - many) <= shingle_dedup.RADIUS - 20


def test_rows_not_ids_are_kept(spark, make_docs, words):
    """A repeated doc_id with different texts: the clean one of its rows stays; extra columns too."""
    rnd = random.Random(3)
    a, b = (" ".join(rnd.choice(words) for _ in range(60)) for _ in range(2))
    docs = make_docs([(1, a), (2, a), (2, b), (2, b), (None, b + " x"), (None, "alone and without an id")])
    docs = docs.withColumn("gone", F.lit("g")).withColumn("id", F.lit("i"))
    found = simhash_dedup.one_per_class(docs)
    assert found.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text, r.gone, r.id) for r in found.collect()))) == sorted(map(repr, [(1, a, "g", "i"), (2, b, "g", "i"), (None, "alone and without an id", "g", "i")]))


@pytest.mark.parametrize("most_bits", [1 << 6, 1 << 26])
def test_rows_among_ids(spark, most_bits):
    """None is missed; with too few bits more rows pass, and never others are lost."""
    rows = spark.range(5000).select((F.col("id") * 7919 - 3).alias("id"), F.lit("text").alias("t"))
    ids = rows.where("pmod(id, 11) = 0").select("id")
    want = {r.id for r in ids.collect()}
    found = shingle_dedup.among(rows, ids, most_bits=most_bits)
    inside, outside = ({r.id for r in found(x).collect()} for x in (True, False))
    assert want <= inside and not want & outside and len(inside) + len(outside) == 5000
    assert len(inside) < len(want) + 500 or most_bits == 64
    assert shingle_dedup.among(rows, ids.where("id IS NULL"))(True).count() == 0


def test_near_pairs_of_wide_fingerprints():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**64, (300, 8), dtype=np.uint64)
    for k in range(1, 300, 2):  # from equal to far beyond the radius
        fps[k] = fps[k - 1]
        for b in rng.choice(512, k, replace=False):
            fps[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    want = {(i, j) for i in range(300) for j in (np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]).sum(1) <= 150) + i + 1).tolist()}
    for queries, tile in ((None, None), (None, 64), (100, 37), (0, None)):
        got = [p for i, j in simhash_dedup.near_pairs(fps, 150, queries, tile) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(set(got)) and set(got) == {p for p in want if queries is None or p[0] < queries}
