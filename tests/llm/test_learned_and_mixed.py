"""Toxicity on held-out labels, mixing against its SQL, the pipeline against plain Python."""

import collections
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from porelake import llm
from porelake.llm import secret_scan, source_mixing, toxicity
from tests.llm.test_exact import brute_quality, brute_secrets, brute_simhash, classes, sha
from tests.llm.test_shingle_dedup import brute_classes


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_oracle(spark, duck, sf_dir, name):
    df = llm.queries()[name](spark, sf_dir)
    want = duck.execute(llm.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want.fetchall())


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    lens, chain = np.array([3, 0, 1, 4]), (-0.7, 0.3, 0.5)
    emit = rng.normal(size=lens.sum())
    p, ahead = toxicity.marginals(emit, lens, chain)
    for size in (1, 2, 3):  # cut into pieces
        assert all(np.allclose(x, y) for x, y in zip((p, ahead), toxicity.marginals(emit, lens, chain, size)))
    many = rng.normal(size=3000)
    for some in (np.array([3000]), np.array([700, 0, 1300, 1000])):
        assert all(np.allclose(x, y) for x, y in zip(toxicity.marginals(many, some, chain, 4000), toxicity.marginals(many, some, chain, 64)))
    at = 0
    for n in lens:
        total, each = 0.0, np.zeros(n)
        for code in range(2**n if n else 0):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(e for e, s in zip(emit[at : at + n], y) if s) + sum(chain[{(0, 1): 0, (1, 0): 1, (1, 1): 2}[a, b]] for a, b in zip(y, y[1:]) if a or b))
            total += w
            each += w * np.array(y)
        assert np.allclose(p[at : at + n], each / total if n else [])
        at += n


@pytest.fixture(scope="module")
def toxic_corpus(make_docs, words, spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        w = [rnd.choice(words) for _ in range(rnd.randrange(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rnd.randrange(2, 6)):
                w.insert(rnd.randrange(len(w) + 1), rnd.choice(["vilebug", "nastyrot", "grimslur" + rnd.choice(words)]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "vilebug nastyrot")]
    return make_docs(rows), spark.createDataFrame([*labels, (0, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(toxic_corpus):
    docs, labels = toxic_corpus
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((found[i].score >= 0.5) == (i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert found[1000].score == found[1001].score < 0.5 and found[1000].starts == []
    assert (found[1002].starts, found[1002].ends) == ([0, 8], [7, 16])


def test_score_of_a_document_by_enumeration(spark, make_docs):
    """From the weights to the document's score, over all paths of a small text."""
    model = toxicity.Model({"vile$": 2.0, "vil": 0.5, "rot$": 1.0}, -1.0, (-1.0, 0.2, 0.8), (-2.0, 1.5, 0.7))
    words = ["a", "Vile", "b-rot", "vile!", "vilest"]
    emit = [-1.0, 1.5, 0.0, 1.5, -0.5]
    total, each = 0.0, np.zeros(5)
    for code in range(32):
        y = [code >> k & 1 for k in range(5)]
        w = np.exp(sum(e for e, s in zip(emit, y) if s) + sum({(0, 0): 0.0, (0, 1): -1.0, (1, 0): 0.2, (1, 1): 0.8}[p] for p in zip(y, y[1:])))
        total += w
        each += w * np.array(y)
    p = each / total
    want = 1 / (1 + np.exp(2.0 - 1.5 * np.log1p(p.sum()) - 0.7 * p.max()))
    found = toxicity.score(make_docs([(1, " ".join(words)), (1, " ".join(words)), (2, "")]), model).collect()
    assert [r.score for r in found[:2]] == pytest.approx([want, want]) and found[2].score == pytest.approx(1 / (1 + np.exp(2.0)))
    starts = np.cumsum([0] + [len(w) + 1 for w in words])[:-1]
    assert found[0].starts == [s for s, x in zip(starts, p) if x > 0.5]


def test_chain_beats_the_lexicon(spark, make_docs, words):
    """Spans of three words whose middle one is plain: a list of words finds two of three."""
    rnd = random.Random(12)
    rows, labels, gold = [], [], {}
    for i in range(500):
        w = [rnd.choice(words) for _ in range(rnd.randrange(20, 80))]
        if i % 3 == 0:
            at = rnd.randrange(1, len(w) - 3)
            w[at : at + 3] = [rnd.choice(["vilebug", "grimslur"]), w[at + 1], rnd.choice(["nastyrot", "foulmuck"])]
            gold[i] = at
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i in gold)))
    docs = make_docs(rows)
    held = toxicity.held_out()
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ~held)
    tagged = {r.doc_id: set(r.starts) for r in toxicity.score(docs.where(held), model).collect()}
    right = found = wanted = lexicon = 0
    for i, t in rows:
        if i in tagged:
            starts = np.cumsum([0] + [len(x) + 1 for x in t.split()])[:-1].tolist()
            span = set(starts[gold[i] : gold[i] + 3]) if i in gold else set()
            right, found, wanted, lexicon = right + len(span & tagged[i]), found + len(tagged[i]), wanted + len(span), lexicon + 2 * bool(span)
    f1 = lambda hit, said: 2 * hit / (said + wanted)
    assert wanted > 60 and f1(right, found) > f1(lexicon, lexicon) + 0.1


def test_toxicity_without_classes(toxic_corpus):
    docs, labels = toxic_corpus
    for some, want in ((labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0), (labels.where("toxic = 7"), 0.0)):
        model = toxicity.fit(docs, some, F.lit(True))
        assert {r.score for r in toxicity.score(docs, model).collect()} == {want}
    assert toxicity.score(docs.where("doc_id < 0"), model).count() == 0
    for d, x in ((docs.where("doc_id < 0"), labels), (docs, labels.where("doc_id < 0"))):
        model = toxicity.fit(d, x, F.lit(True))  # an empty table
        assert 0 <= toxicity.score(docs, model).first().score <= 1


@pytest.fixture(scope="module")
def uneven(make_docs, words):
    rnd = random.Random(9)
    rows = []
    for i in range(900):
        source = "hot" if i % 2 else rnd.choice(["a", "b", "c", "d", None])
        rows.append((i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60))), source))
    rows += [(2000, None, "void"), (2001, "", "void")]
    return rows, make_docs(rows)


@pytest.mark.parametrize("share", [0.9, 0.3, 0.97, 0.05])
def test_mixing_uneven_sources(uneven, duck, share):
    rows, docs = uneven
    found = source_mixing.mixture(docs, entropy_share=share)
    duck.register("documents_mix", docs.toPandas())
    want = duck.execute(source_mixing.mixing_sql(share).replace("FROM documents", "FROM documents_mix"))
    names = [d[0] for d in want.description]
    assert rows_of(found.columns, found.collect()) == rows_of(names, want.fetchall())
    uses = collections.Counter(r.doc_id for r in found.collect())
    assert set(uses) == {r[0] for r in rows}  # the default budget uses every document
    again = collections.Counter(r.doc_id for r in source_mixing.mixed(docs, entropy_share=share).collect())
    assert again == uses and source_mixing.mixed(docs).columns == docs.columns
    assert source_mixing.mixture(docs.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("share", [0.999, 0.9, 0.5, 0.3, 0.01])
def test_mixing_meets_the_entropy(make_docs, share):
    """Also below the natural entropy of 60:40, 0.971 of the largest."""
    docs = make_docs([(i, "a b c d", "big" if i < 60 else "small") for i in range(100)])
    w = [r.weight for r in source_mixing.mixing_plan(source_mixing._base(docs), entropy_share=share).collect()]
    assert sum(w) == pytest.approx(1)
    assert -sum(x * np.log(x) for x in w) / np.log(2) == pytest.approx(share, abs=1e-6)


def test_mixing_targets_out_of_reach(make_docs):
    three = source_mixing._base(make_docs([(i, "a b c d", "xyy"[i % 3] if i < 90 else "z") for i in range(92)]))
    alike = source_mixing._base(make_docs([(i, "a b c d", "xy"[i % 2]) for i in range(10)]))
    two_large = source_mixing._base(make_docs([(i, "a b", "xyxyz"[i % 5]) for i in range(50)]))
    for base, target in ((three, {"entropy_share": 1.2}), (three, {"entropy_share": -0.1}), (three, {"entropy_share": None, "max_repeats": 0.5}), (two_large, {"entropy_share": 0.5}), (three, {"entropy_share": None})):
        with pytest.raises(ValueError):
            source_mixing.mixing_plan(base, **target)
    assert [r.weight for r in source_mixing.mixing_plan(alike, entropy_share=0.3).collect()] == [0.5, 0.5]


def test_mixing_keeps_clashing_columns(uneven):
    rows, docs = uneven
    names = ["src", "cut", "blocks", "block", "rest", "_mix_src", "KEY", "tokens", "a.b"]
    more = docs
    for n in names:
        more = more.withColumn(n, F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")))
    found = source_mixing.mixed(more)
    assert found.columns == more.columns
    got = found.collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in source_mixing.mixed(docs).collect())
    assert all(r[n] == f"{n}:{r.doc_id}" for r in got for n in names)
    assert sorted(map(tuple, source_mixing.mixture(more).collect())) == sorted(map(tuple, source_mixing.mixture(docs).collect()))


def test_mixing_repeated_rows_count_one_by_one(make_docs):
    docs = make_docs([(1, "a b c", "x"), (1, "a b c", "x"), (2, "a b c", "x"), (None, "a b", "x"), (3, "a", "y")])
    found = source_mixing.mixture(docs, entropy_share=None, max_repeats=1.0)
    assert collections.Counter(r.doc_id for r in found.collect()) == {1: 2, 2: 1, None: 1, 3: 1}


def test_mixing_repeat_limit_and_budget(make_docs):
    docs = make_docs([(i, "a b c d", "big" if i < 80 else "small") for i in range(100)])
    base = source_mixing._base(docs)
    plan = {r.src: r for r in source_mixing.mixing_plan(base, entropy_share=None, max_repeats=2.0).collect()}
    uses = {s: (r.blocks * r.tokens + r.rest) / r.tokens for s, r in plan.items()}
    assert uses["small"] / uses["big"] == pytest.approx(2.0, rel=1e-3)
    plan = source_mixing.mixing_plan(base, entropy_share=1.0, budget=200.0).collect()
    assert sum(r.blocks * r.tokens + r.rest for r in plan) == pytest.approx(200.0, rel=1e-6)


def brute_pipeline(rows):
    """(doc_id, text, source) after the first three stages, in plain Python."""
    keep = [(i, t, s) for i, t, s in rows if (m := brute_quality(t or ""))[0] >= 10 and 100 * m[4] <= 20 * m[0]]
    root, _ = brute_classes([t for _, t, _ in keep])  # rows in order of doc_id: the first of a class is its smallest
    keep = [r for k, r in enumerate(keep) if root[k] == k]
    out = []
    for i, t, s in keep:
        at, parts = 0, []
        for a, _, e in brute_secrets(t, secret_scan.RULES):
            if a >= at:
                parts += [t[at:a], "[secret]"]
            at = max(at, e)
        out.append((i, "".join([*parts, t[at:]]), s))
    return out


def test_pipeline(spark, sf_dir, duck, tmp_path):
    """Near-duplicates go at a similarity of 0.8 of 5-word shingles; each use of a document counts."""
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    rows = duck.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()
    want = brute_pipeline(rows)
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: t.encode(x, add_special_tokens=False).ids for i, x, _ in want}
    duck.register("documents_left", pd.DataFrame(want, columns=["doc_id", "text", "source"]))
    uses = collections.Counter(r[0] for r in duck.execute("SELECT doc_id FROM (" + source_mixing.mixing_sql(0.9).replace("FROM documents", "FROM documents_left") + ")").fetchall())
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert collections.Counter(r.doc_id for r in found) == uses and set(uses) == set(ids)
    assert all(list(r.ids) == ids[r.doc_id] and r.n_tokens == len(r.ids) for r in found)


def test_registered_queries_equal_brute_force(spark, sf_dir, duck):
    """Operators 4, 7 and 9 as registered, over the whole table; those with SQL are tested with it."""
    rows = [(i, t or "") for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()]
    got = lambda n, *c: sorted(map(tuple, llm.queries()[n](spark, sf_dir).select(*c).collect()))
    fps = [brute_simhash(t) for _, t in rows]
    assert got("op4_simhash_dedup", "doc_id", "fingerprint", "component_id") == sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, classes([i for i, _ in rows], fps, 2)))
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tok.encode(t, add_special_tokens=False).ids for i, t in rows}
    want = sorted((i, len(x), sha(",".join(map(str, x)).encode()), sha(tok.decode(x, skip_special_tokens=False).encode())) for i, x in ids.items())
    assert got("op7_bpe_round_trip", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    n = {i: len(sp.encode(t)) for i, t in rows}
    assert got("op9_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted((i, len(t.encode()), n[i], n[i] > 4096) for i, t in rows)


def test_stages_keep_columns(spark, make_docs, tmp_path):
    docs = make_docs([(1, "one two three four five six seven eight nine ten eleven", None), (2, None), (3, "")]).withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == list(corpus_pipeline.COLUMNS), name
        assert stage(spark, docs.where("doc_id < 0"), str(tmp_path)).count() == 0
