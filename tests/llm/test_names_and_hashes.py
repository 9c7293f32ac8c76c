"""Colliding words, block ids of repeated tasks, names of columns, numbers beyond 64 bits, empty tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from porelake import llm
from porelake.llm import _blocks, bpe_codec, quality_rules, secret_scan, simhash_dedup, source_mixing, topk_search, window_dedup
from tests.llm.test_exact import got


def thue_morse(n, first="a"):
    text = first
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text


@pytest.mark.parametrize("letters", [256, 512, 1024, 2048, 8192])
def test_words_that_collide_in_polynomials(make_docs, letters):
    """49 words shared, the last one complemented: no window repeats, and nothing goes."""
    shared = [f"w{k}" for k in range(49)]
    a, b = thue_morse(letters), thue_morse(letters, "b")
    rows = [(1, " ".join([*shared, a])), (2, " ".join([*shared, b])), (3, " ".join([*shared, b, "end"]))]
    found = {r.doc_id: r.n_removed for r in window_dedup.remove_repeats(make_docs(rows)).collect()}
    assert found == {1: 0, 2: 0, 3: 50}


def test_word_hashes_tell_words_apart():
    rnd = random.Random(1)
    words = {bytes(rnd.choices(b"ab\0\xff", k=rnd.choice([1, 7, 8, 9, 15, 16, 17, 511, 512, 513, 700]))) for _ in range(20_000)} | {b"a" * k for k in range(1, 600)} | {b"\0" * k for k in range(1, 600)}
    words = sorted(words)
    for which in (0, 1):
        h, n = window_dedup.word_hashes([b" ".join(words[:100]), b"", b" ".join(words[100:])], which, step=777)
        assert len(set(h.tolist())) == len(words) == n.sum() and n.tolist()[1] == 0
        again, _ = window_dedup.word_hashes([b"\n".join(words[::-1])], which)
        assert (again[::-1] == h).all()
    assert not set(h.tolist()) & set(window_dedup.word_hashes([b" ".join(words)], 0)[0].tolist())


def test_blocks_are_numbered_alike_each_time(spark, make_docs, corpus, tmp_path):
    make_docs(corpus).repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    runs = []
    for _ in range(2):
        blocks, _ = _blocks.pack_blocks(docs, "numbers")
        runs.append(sorted((r.block, hashlib.sha256(r.payload).hexdigest()) for r in blocks.collect()))
    assert runs[0] == runs[1] and len({b for b, _ in runs[0]}) == len(runs[0]) > 1


ODD_NAMES = ["a.b", "_near_row", "kept0", "bucket", "`x`", "id", "spans", "c d"]


@pytest.mark.parametrize("stage", [secret_scan.redact_secrets, simhash_dedup.one_per_class, quality_rules.keep_good])
def test_any_name_of_a_column(make_docs, words, stage):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(words) for _ in range(40)) for _ in range(6)]
    docs = make_docs([*enumerate(texts), (7, texts[0]), (None, texts[1] + " password=abcdefghijklmnop")])
    clashing = docs.select("*", *[F.col("doc_id").alias(c) for c in ODD_NAMES])
    plain, odd = stage(docs), stage(clashing)
    assert odd.columns == clashing.columns
    rows = odd.collect()
    assert sorted((r[:5] for r in map(tuple, rows)), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert all(set(r[5:]) == {r[0]} for r in map(tuple, rows))


@pytest.mark.parametrize("x", [1e300, -1e300, 1e17, 9.1e15])
def test_topk_beyond_64_bits_is_an_error(spark, x):
    df = spark.createDataFrame([(0, [x, 1.0]), (1, [1.0, 1.0]), (2, [0.5, -1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk_search.top_k(df, F.col("vec_id") == 0).collect()


def test_topk_of_repeated_and_wide_rows(spark):
    wide = [0.25] * 5000
    df = spark.createDataFrame([(0, wide), (0, wide), (1, wide), (1, wide), (2, wide[:10])], "vec_id long, embedding array<double>")
    assert got(topk_search.top_k(df, F.col("vec_id") == 0, most_cells=6000), "query_id", "rank", "vec_id", "score") == sorted([(0, k, 1, 5000 * 256**2) for k in (1, 2)] * 2, key=repr)


def test_registered_toxicity(spark, sf_dir):
    """One row a document, folds by checksum, scores that agree with the predictions, and held-out labels mostly right."""
    import zlib

    rows = llm.queries()["op5_toxicity"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) >= 0.9


def test_stages_of_empty_tables(spark, make_docs, tmp_path):
    empty = make_docs([(1, "x")]).where("doc_id < 0")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert source_mixing.mixed(empty).count() == 0


def test_long_texts_in_stages(spark, make_docs, words):
    """Texts of a megabyte through the stages that have no such test elsewhere."""
    rnd = random.Random(3)
    text = " ".join(rnd.choice(words) + str(rnd.randrange(10**6)) for _ in range(90_000))
    docs = make_docs([(1, text), (2, text + " end"), (3, "short words " * 3)])
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} >= {1, 2}
    assert sorted(r.doc_id for r in simhash_dedup.one_per_class(docs).where("doc_id < 3").collect()) == [1]
    mixed = source_mixing.mixed(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in mixed} == {1, 2, 3}
    import public_tokenizers

    ids = bpe_codec.encode_columns(docs.where("doc_id = 1"), public_tokenizers.path("byte_bpe_50k.json"), ("doc_id",)).first()
    assert len(ids.ids) > 90_000
