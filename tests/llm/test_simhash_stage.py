"""The pipeline's near-duplicate stage by operator 4's steps: blocks of fingerprints, bit-sliced comparison."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from porelake.llm import shingle_dedup, simhash_dedup
from tests.llm.test_shingle_dedup import brute_classes, edited  # noqa: F401  a fixture


def fingerprints_of(texts):
    return np.stack([shingle_dedup.fingerprint(shingle_dedup.shingle_set(t, 5)) for t in texts])


def test_blocks_of_fingerprints_give_the_candidates(spark, edited):  # noqa: F811
    """A row for each block of a fingerprint; all pairs at the similarity share a bucket, at any width."""
    texts = [t for t in edited if t]
    _, pairs = brute_classes(texts)
    fps = fingerprints_of(texts)
    for n in (len(texts), 1 << 22):
        blocks, bits = shingle_dedup.blocks_for(n)
        keys = [set(k) for k in shingle_dedup.block_keys(fps, blocks, bits).tolist()]
        assert sum(bool(keys[i] & keys[j]) for i, j in pairs) >= 0.999 * len(pairs)
    sets = spark.createDataFrame([(i, 9, f.tolist()) for i, f in enumerate(fps[:30])], "id long, n int, fp array<long>")
    want = {(i, k) for i, row in enumerate(shingle_dedup.block_keys(fps[:30], 60, 11).tolist()) for k in row}
    assert {(r.id, r.bucket) for r in shingle_dedup.filed(sets, 60, 11).collect()} == want


def test_screen_holds_all_pairs(edited):  # noqa: F811
    texts = [t for t in edited if t]
    head = fingerprints_of(texts)[:, : shingle_dedup.SCREEN].view(np.uint64)
    _, pairs = brute_classes(texts)
    assert max(int(np.bitwise_count(head[i] ^ head[j]).sum()) for i, j in pairs) <= shingle_dedup.SCREEN_RADIUS


def test_near_in_groups():
    """As a comparison of all with all, for small groups, large ones, and rows that ask nothing."""
    rng = np.random.default_rng(4)
    for width, radius, cells in ((1, 3, 7), (3, 60, 1 << 14), (2, 41, 500), (8, 150, 3000)):
        sizes = rng.integers(1, 200, 7)
        asks = np.minimum(sizes, np.r_[sizes[:4], rng.integers(0, 150, 3)])
        fps = rng.integers(0, 2**64, (sizes.sum(), width), dtype=np.uint64)
        for k in range(1, len(fps), 2):
            fps[k] = fps[k - 1]
            for b in rng.choice(64 * width, rng.integers(0, 2 * radius), replace=False):
                fps[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        group, starts = np.repeat(np.arange(7), sizes), np.cumsum(sizes) - sizes
        near = (np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= radius) & (group[:, None] == group)
        want = {(i, j) for i, j in np.argwhere(near).tolist() if i < j and i - starts[group[i]] < asks[group[i]]}
        got = [p for i, j in simhash_dedup.near_in_groups(fps, sizes, asks, radius, cells) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize("rounds,most,few", [(1, 20, 4), (3, 20, 0), (1, 10**6, 0), (2, 20, 10**6)])
def test_crowded_buckets_lose_no_link(spark, edited, monkeypatch, rounds, most, few):  # noqa: F811
    """Buckets above and below the limit, with many tiles, few pairs or many: the classes are the same."""
    for name, value in (("MOST", most), ("PAIRS_A_ROW", few), ("TILE_ROWS", 30), ("SWEEP", 50), ("TILE", 3000)):
        monkeypatch.setattr(shingle_dedup, name, value)
    texts = [t for t in edited if t][:200]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    n = [len(shingle_dedup.shingle_set(t, 5)) for t in texts]
    keyed = spark.createDataFrame([(i, n[i], b) for i in range(len(texts)) for b in ([1, 2 + i % 19] if i % 3 else [1])], "id long, n int, bucket long")
    fps = spark.createDataFrame([(i, n[i], f.tolist()) for i, f in enumerate(fingerprints_of(texts))], "id long, n int, fp array<long>")
    root = {r.id: r.root for r in shingle_dedup.roots_of(keyed, fps, df, 5, 0.8, rounds).collect()}
    assert [root.get(i, i) for i in range(len(texts))] == brute_classes(texts)[0]


def test_families_have_the_buckets_of_filed_rows(spark, edited):  # noqa: F811
    """A fingerprint travels once for the blocks of a family, and a third of the times it did or fewer."""
    for n, before in ((1 << 17, 60), (1 << 24, 180)):
        blocks, bits = shingle_dedup.blocks_for(n)
        assert blocks % shingle_dedup.TOGETHER == 0 and 3 * blocks // shingle_dedup.TOGETHER <= before
    fps = fingerprints_of([t for t in edited if t][:20])
    sets = spark.createDataFrame([(i, 9, f.tolist()) for i, f in enumerate(fps)], "id long, n int, fp array<long>")
    for blocks, bits in (shingle_dedup.blocks_for(20), shingle_dedup.blocks_for(1 << 24)):
        want = sorted((r.id, r.bucket) for r in shingle_dedup.filed(sets, blocks, bits).collect())
        rows = shingle_dedup.families_of(sets, blocks, bits)
        family, own = F.col("family"), F.col("own")
        got = rows.select("id", family, F.explode(F.array(*[shingle_dedup.bucket_in(family, own, j, bits) for j in range(shingle_dedup.TOGETHER)])).alias("bucket"))
        got = got.withColumn("again", shingle_dedup.family_in(F.col("bucket"), bits)).collect()
        assert sorted((r.id, r.bucket) for r in got) == want and all(r.family == r.again for r in got)
        r = rows.first()
        assert {shingle_dedup.bucket_in(np.array([r.family]), np.array([r.own]), j, bits)[0] for j in range(shingle_dedup.TOGETHER)} <= {b for i, b in want if i == r.id}


def test_near_copies_give_few_edges(spark):
    """A group of 400 near copies, in 30 buckets of two thirds of it each: about as many edges as rows, not
    the pairs of a bucket nor a tree of its own for each, and all of them connected."""
    rng = np.random.default_rng(8)
    fp = np.repeat(rng.integers(-(2**62), 2**62, (1, shingle_dedup.SCREEN)), 400, axis=0)
    fp ^= 1 << rng.integers(0, 60, fp.shape)
    rows = [(b, 0, 0, 0, i, 100, i, *fp[i].tolist()) for b in range(30) for i in rng.permutation(400).tolist() if (i * 7 + b) % 3]
    df = spark.createDataFrame(rows, "bucket long, x int, y int, tile int, id long, n int, class long, fp0 long, fp1 long, fp2 long")
    found = {(r.a, r.b) for r in shingle_dedup.near_of_groups(df, 0.8).collect()}
    assert len(found) <= 3 * 400 and set(simhash_dedup.forest(400, *np.array(sorted(found)).T)) == {0}


@pytest.mark.parametrize("most", [10, 40, 10**6])
def test_families_and_crowded_buckets_together(spark, edited, monkeypatch, most):  # noqa: F811
    """Families without a crowded bucket, with some, with only such: the classes are those of brute force."""
    for name, value in (("MOST", most), ("SWEEP", 200), ("TILE_ROWS", 30)):
        monkeypatch.setattr(shingle_dedup, name, value)
    texts = [t for t in edited if t][:200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in shingle_dedup.one_per_class(docs).collect()) == sorted(set(brute_classes(texts)[0]))
