"""Phrases, hard negatives and url filters against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from porelake.llm import collocations, hard_negatives, url_filter
from tests.llm.test_exact import got

# 11 ---------------------------------------------------------------------------------------------

PIECE, WORD = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^\x20\x09]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, least, top):
    """rows: (text, lang)"""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(ASCII_LOWER)):
            words = WORD.findall(piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang in n:
        known = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        kept = []
        for p, a in known.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in known.items()):
                continue
            score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out, key=repr)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
PHRASE_SCHEMA = "doc_id long, text string, lang string, salt int, phrase string"


@pytest.fixture(scope="module")
def phrases_corpus():
    rnd = random.Random(11)
    words = ["The", "of", "Zug", "é", "a\x0bb", "\x00x", "x\xa0y", "漢字", "q", "ÀB"] + [f"w{i}" for i in range(12)]
    rows = [(" ".join(rnd.choices(words, weights=[9, 7, *[2] * 20], k=rnd.randrange(0, 60))).replace("w3", "w3."), rnd.choice(["en", "de", None, "und"])) for _ in range(150)]
    rows += [("New york city, new York\tCITY  new york", "en")] * 12 + [("tie one; tie two", "fr")] * 10
    rows += [(None, "en"), ("", None), (" \t ", "en"), (".,;:!?\r\n", "xx"), ("x" * 5000, "en"), ("hot pair " * 4000, "en")]
    return rows


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0, "clash") for i, (t, lang) in enumerate(rows)], PHRASE_SCHEMA).repartition(3)


@pytest.mark.parametrize("least, top", [(10, 2000), (2, 7)])
def test_phrases(spark, phrases_corpus, least, top):
    found = collocations.collocations(docs_of(spark, phrases_corpus), least, top, salts=4)
    assert got(found, *COLUMNS) == brute_phrases(phrases_corpus, least, top)


def test_phrases_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [("x", "en")]).where("doc_id < 0")).count() == 0
    assert collocations.collocations(docs_of(spark, [(None, None), ("a b", None)])).count() == 0


def test_small_tries_count_alike(phrases_corpus, monkeypatch):
    """Bursts, spilled subtrees, a vocabulary that is dropped midway and texts cut into parts change no count."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["und" if x is None else x for _, x in phrases_corpus], "text": [t or "" for t, _ in phrases_corpus]})

    def total(entries, most_words, size):
        out = Counter()
        for b in collocations._count(iter([batch, batch]), size, None, entries, most_words, 1 << 20):
            rows = list(zip(*[c.to_pylist() for c in b.columns]))
            assert [p.encode() for _, p, _ in rows] == sorted(p.encode() for _, p, _ in rows) or rows[0][1] == ""
            for lang, phrase, f in rows:
                out[lang, phrase] += f
        return out

    want = {size: total(10**6, 10**6, size) for size in (2, 3)}
    real, init = collocations._parts, collocations.HatTrie.__init__
    monkeypatch.setattr(collocations, "_parts", lambda data: real(data, 64))
    monkeypatch.setattr(collocations.HatTrie, "__init__", lambda self: init(self, 4))
    for size in (2, 3):
        assert total(50, 30, size) == want[size]


def test_trie_ranges():
    rnd = random.Random(3)
    keys = [rnd.choice([1, 2, 7]) << 42 | rnd.randrange(4) << 21 | rnd.randrange(200) for _ in range(5000)]
    trie = collocations.HatTrie(burst=16)
    for at in range(0, 5000, 700):
        trie.add(np.array(keys[at : at + 700], np.int64))
    want = Counter(keys)
    assert trie.size == len(want) and all(trie.count(k) == n for k, n in want.items())
    assert trie.starts == sorted(set(trie.starts)) and max(map(len, trie.containers)) <= 16
    taken = Counter({int(k): int(n) for ks, ns in trie.take(100) for k, n in zip(ks, ns)})
    assert trie.size <= 100 and taken + Counter({k: n for c in trie.containers for k, n in c.items()}) == want


def test_scores_pass_64_bits(spark):
    a, left, right = 10**14, 10**14 + 7, 10**15 - 3
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * a * a // (left * right)


def test_pair_table_has_every_pair(spark):
    rnd = random.Random(2)
    pairs = [("en", f"wörd{rnd.randrange(50)}", f"{rnd.randrange(10**6)}") for _ in range(300)]
    marked = np.frombuffer(collocations.pair_table(spark.createDataFrame(pairs, "lang string, w1 string, w2 string")), np.uint8)
    import xxhash

    h = lambda s: np.array([xxhash.xxh64_intdigest(s.encode(), 42)], np.uint64)
    hit = [bool(collocations.is_marked(marked, collocations._pair_places(h(a), h(b), h(x)[0], len(marked) * 8))[0]) for x, a, b in pairs]
    assert all(hit)
    missed = [collocations.is_marked(marked, collocations._pair_places(h(f"n{i}"), h("m"), h("en")[0], len(marked) * 8))[0] for i in range(300)]
    assert sum(missed) < 30


# 12 ---------------------------------------------------------------------------------------------


def brute_negatives(rows, positives=5, negatives=3):
    fine = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        fine.append((i, [int(np.floor(256 * float(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, x, label in fine:
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, lb) for i, y, lb in fine if i != a and len(y) == len(x))
        for s, p, _ in [t for t in scored if t[2] == label][:positives]:
            fit = [t for t in scored if t[2] != label and 50 * -s <= 100 * -t[0] <= 95 * -s][:negatives]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(fit)]
    return sorted(out, key=repr)


MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def vectors_of(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, label, "clash", 1) for i, v, label in rows], f"vec_id long, embedding array<{kind}>, label int, shard string, anchor_row int")


@pytest.fixture(scope="module")
def vectors():
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-0.5, 0.25, 0.1, 1.0, 0.7]) for _ in range(5)], rnd.randrange(3)) for i in range(260)]
    rows += [(300, [float("nan")] * 5, 1), (350, None, 1), (400, [0.5, None, 1.0, 1.0, 1.0], 2), (450, [1.0], 1), (451, [2.0], 1), (452, [1.5], 2), (453, [1.2], 0)]
    rows += [(500, [float("inf")] * 5, 0), (550, [], 1), (551, [], 1), (552, [], 0), (600, [0.3] * 5, None), (None, [0.3] * 5, 1), (650, [0.0] * 5, 9), (700, [-1.0] * 5, 9), (-50, [0.7] * 5, 1)]
    return rows + [rows[3], rows[52], rows[100]]


@pytest.mark.parametrize("shard, group", [(40, 2), (10_000, 100)])
def test_hard_negatives(spark, vectors, shard, group):
    found = hard_negatives.mined(vectors_of(spark, vectors), F.col("vec_id") % 50 == 0, shard_rows=shard, group_rows=group, fan=3)
    assert got(found, *MINED) == brute_negatives(vectors)


def test_hard_negatives_of_nothing(spark, vectors):
    assert hard_negatives.mined(vectors_of(spark, vectors).where("vec_id < -60"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("size, dim", [(1, 4), (300, 64), (10**6, 8), (10**9, 3), (10**9, 1), (1, 0)])
def test_packed_products_are_exact(size, dim):
    """Two and more fields in a double, and Python's integers where they do not fit."""
    rnd = np.random.default_rng(size)
    a, c = (rnd.integers(-size, size + 1, (n, dim)) for n in (7, 53))
    packed = hard_negatives.Packed(c.astype(float), *hard_negatives.field_bits(a.astype(float), c.astype(float)))
    assert (packed.scores(a.astype(float)) == a @ c.T).all()
    assert packed.exact == (size <= 300) and packed.fields >= 2


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = [(0, [1e12, 1.0], 1), (1, [1e12, 1.0], 1), (2, [-1e12, 0.5], 2)]
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mined(vectors_of(spark, rows), F.col("vec_id") % 50 == 0).collect()


def test_wide_vectors(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(3000)], i % 2) for i in range(8)] + [(50, [rnd.uniform(0, 1) for _ in range(3000)], 0)]
    found = hard_negatives.mined(vectors_of(spark, rows), F.col("vec_id") % 50 == 0, most_cells=9000)
    assert got(found, *MINED) == brute_negatives(rows)


# 13 ---------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/1?q#f", "https://example.com/EN/", "http://www.example.com/en/2", "ftp://a.www.example.com/en/", "http://notexample.com/en/",
    "http://a.net/es/1", "http://a.net/fr/", "http://a.net/de/", "http://b.net/fr", "http://net/es/", "http://x.org/a://b", "http://x.org?y/z", "http://x.org#://", "HTTP://ÄB.org/É/?x",
    "http://user@free-bets.org:80/x", "http://free-bets.org/x", "http://spam-farm.com/", "http://c.net/en/", "http://c.net/es/", "http://c.net/fr/x", "://", "http:///path", "http://com", "http://com/", "http://d.org/" + "y" * 50_000, "http://q.net/es/\nline",
]


def brute_pages(rows, listed=None):
    judged = []
    for i, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.translate(ASCII_LOWER)
        fit = [(len(h + p), len(h), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        judged.append((i, host, path, *(max(fit)[2:] if fit else (None, None))))
    n, bad = Counter(h for _, h, *_ in judged), Counter(h for _, h, _, _, v in judged if v == "block")
    if listed is None:
        listed = {h for h in n if h and (set(h.split(".")) & set(url_filter.SPAM_LABELS) or 2 * bad[h] > n[h])}
    return sorted([(i, h, p, r, v or ("block" if h in listed else "allow")) for i, h, p, r, v in judged], key=repr)


JUDGED = ("page_id", "host", "path", "rule", "verdict")


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, "x", True, "y") for i, u in rows], "page_id long, url string, html string, listed boolean, key string")


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_url_filter(spark, most_bytes):
    rnd = random.Random(9)
    rows = list(enumerate(URLS)) + [(100, URLS[4])] * 3 + [(None, URLS[9])]
    rows += [(200 + i, f"http://h{rnd.randrange(60)}.{rnd.choice(['net', 'org'])}/{rnd.choice(['en', 'es', 'fr'])}/{i}") for i in range(400)]
    found = url_filter.judged(pages_of(spark, rows), most_bytes=most_bytes, shard_keys=7)
    assert got(found, *JUDGED) == brute_pages(rows)


def test_url_filter_with_a_list(spark):
    rows = [(i, f"http://h{i % 500}.org/") for i in range(1500)]
    hosts = [f"h{i}.org" for i in range(0, 500, 3)] + ["elsewhere.org", "", None, "h0.org"]
    listed = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert got(url_filter.judged(pages_of(spark, rows), listed), *JUDGED) == brute_pages(rows, set(hosts))
    assert {r.verdict for r in url_filter.judged(pages_of(spark, rows), listed.where("host = 'none'")).collect()} == {"allow"}
    assert url_filter.judged(pages_of(spark, rows).where("page_id < 0")).count() == 0


def test_cascade_is_exact(spark):
    """Few bits a key: many levels, and still no key is told wrongly."""
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 5 == 0).alias("listed"))
    c = url_filter.cascade(keys, shard_keys=200, bits_a_key=1)
    assert len(c.levels) > 3 and c.shards == 3
    for most in (1 << 20, 0):
        assert c.mark(keys, "key", "found", most).where("found != listed").count() == 0
