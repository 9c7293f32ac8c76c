"""Operator 11: phrase collocation mining by HAT-trie counting.

Words get ids within a task, and n-grams are numbers made of their words' ids, so that a trie's
subtrees are ranges of numbers. ``HatTrie`` keeps a shallow trie over them: hash containers, each of
one range; a container that grows too large bursts in two, between two words if it holds several
first words, else below. When a task's trie holds too many entries, the largest subtrees leave it as
runs sorted by phrase; runs meet in partitions by the whole path (a prefix alone may hold a third
of all rows), where Spark adds them up.

Words and pairs are counted first. A triple can only be a candidate if both of its pairs are, so the
frequent pairs are marked in a bit table of bounded size, and the second pass counts those triples
whose pairs' bits are set: never too few, and the counts of what passes are whole.

Defined results: a null text is empty, a null lang is ``und``; only A-Z are lower-cased. Words are
[^\\x20\\x09]+ within pieces cut at [.,;:!?\\x0A-\\x0D], so any other character is part of a word. Very long texts
are counted in parts that overlap by two words. Rows count one by one, repeated ones too. Ties go by
count, then phrase in byte order. An empty table gives no rows. Further columns are ignored, whatever
their names. Counts are longs; scores come from decimals of 38 digits (counts up to 10**15).
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from porelake.llm._shared import bit_table, is_marked, map_batches, materialize, slices, table

BITS = 21  # of a word's id within a task
ID = (1 << BITS) - 1
BREAKS = b".,;:!?\n\x0b\x0c\r"
# one table for lower case, tabs and the ends of pieces, all of them single bytes in UTF-8
FOLDED = bytes(b"."[0] if c in BREAKS else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))
RUN_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


class HatTrie:
    """Counts of numbers below 2**63. ``starts`` are the first numbers of the containers' ranges."""

    def __init__(self, burst: int = 16384):
        self.burst, self.starts, self.containers = burst, [0], [Counter()]
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        at = np.searchsorted(np.array(self.starts, np.int64), keys, "right") - 1
        order = np.argsort(at, kind="stable")
        keys, at = keys[order], at[order]
        ends = np.flatnonzero(np.diff(at, append=-1)) + 1
        begin = 0
        grown = []
        for end in ends:
            k = int(at[end - 1])
            held = self.containers[k]
            before = len(held)
            held.update(keys[begin:end].tolist())
            self.size += len(held) - before
            if len(held) > self.burst:
                grown.append(k)
            begin = end
        for k in reversed(grown):
            self._burst(k)

    def _burst(self, k: int) -> None:
        """Two subtrees instead of one, and so on while they are too large."""
        held = self.containers[k]
        keys = np.sort(np.fromiter(held.keys(), np.int64, len(held)))
        middle = int(keys[len(keys) // 2])
        for shift in (2 * BITS, BITS, 0):  # between first words if there are two, else between the next ones
            cut = middle >> shift << shift
            cut = cut if keys[0] < cut else cut + (1 << shift)
            if cut <= keys[-1]:
                break
        low, high = Counter(), Counter()
        for key, n in held.items():
            (low if key < cut else high)[key] = n
        self.containers[k : k + 1] = [low, high]
        self.starts.insert(k + 1, cut)
        for place in (k + 1, k):
            if len(self.containers[place]) > self.burst:
                self._burst(place)

    def take(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, counts) of the largest subtrees, which become empty, until at most so many entries are left."""
        for k in sorted(range(len(self.containers)), key=lambda k: -len(self.containers[k])):
            if self.size <= most:
                return
            held, self.containers[k] = self.containers[k], Counter()
            self.size -= len(held)
            if held:
                yield np.fromiter(held.keys(), np.int64, len(held)), np.fromiter(held.values(), np.int64, len(held))

    def count(self, key: int) -> int:
        return self.containers[bisect_right(self.starts, key) - 1][key]


class _Words(dict):
    """Ids of a language's words; id 0 is the end of a piece."""

    def __init__(self, lang: str, names: list, langs: list):
        super().__init__({b".": 0})
        self.lang, self.names, self.langs = lang, names, langs

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.names)
        self.names.append(word)
        self.langs.append(self.lang)
        return found


class _Vocabulary:
    """Words of a task with ids of their own for each language, dropped when they become many."""

    def __init__(self, most: int, most_bytes: int):
        self.most, self.most_bytes = most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.names, self.langs, self.of, self.seen, self.bytes = [b""], [""], {}, 1, 0
        self.hashes = np.zeros(1, np.uint64)

    def full(self) -> bool:
        self.bytes += sum(map(len, self.names[self.seen :]))
        self.seen = len(self.names)
        return self.seen > self.most or self.bytes > self.most_bytes

    def ids(self, lang: str, found: list[bytes]) -> np.ndarray:
        words = self.of.get(lang)
        if words is None:
            words = self.of[lang] = _Words(lang, self.names, self.langs)
        return np.fromiter(map(words.__getitem__, found), np.int64, len(found))

    def word_hashes(self) -> np.ndarray:
        """XXH64 of each word, as Spark's xxhash64 gives it, for the ids so far."""
        fresh = [xxhash.xxh64_intdigest(w, 42) for w in self.names[len(self.hashes) :]]
        self.hashes = np.concatenate([self.hashes, np.array(fresh, np.uint64)])
        return self.hashes


def _parts(data: bytes, part: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words and ends of pieces, in parts that end between words. bytes.split() cuts at white space of
    ASCII: of that, FOLDED leaves only spaces."""
    data = data.translate(FOLDED)
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > part:
            end = max(data.rfind(b" ", at, at + part), data.rfind(b".", at, at + part)) + 1
            if not end:  # a word longer than a part
                end = min((c + 1 for c in (data.find(b" ", at), data.find(b".", at)) if c >= 0), default=len(data))
        yield data[at:end].replace(b".", b" . ").split()
        at = end


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The batch's texts, joined by language in parts of some megabytes; a piece ends with its text."""
    for part in slices(batch, 1000):
        langs, texts = part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(langs, texts):
            by.setdefault(lang, []).append(text)
        for lang, found in by.items():
            yield lang, b".".join(found)


def _run(words: _Vocabulary, keys: np.ndarray, counts: np.ndarray, size: int) -> pa.RecordBatch:
    """A subtree as rows sorted by phrase; size: words of a phrase."""
    names = pa.array(words.names, pa.binary())
    ids = [(keys >> (BITS * (size - 1 - k))) & ID for k in range(size)]
    phrase = names.take(pa.array(ids[0]))
    for more in ids[1:]:
        phrase = pc.binary_join_element_wise(phrase, names.take(pa.array(more)), b" ")
    rows = pa.RecordBatch.from_arrays([pa.array(words.langs).take(pa.array(ids[0])), phrase.cast(pa.string()), pa.array(counts)], schema=RUN_SCHEMA)
    return rows.take(pc.sort_indices(phrase))


def _count(batches: Iterator[pa.RecordBatch], size: int, table_of_pairs: bytes | None, entries: int, most_words: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Runs of the n-grams of ``size`` words; of words as well, and of the number of words under an
    empty phrase, if there is no table of pairs. With one, n-grams count whose pairs it has."""
    words, trie = _Vocabulary(most_words, most_bytes), HatTrie()
    single, totals = np.zeros(0, np.int64), Counter()
    marked = None if table_of_pairs is None else np.frombuffer(table_of_pairs, np.uint8)

    def spill(most: int) -> Iterator[pa.RecordBatch]:
        # subtrees leave together where they are small, each as a sorted run of rows
        waiting, n = [], 0
        for keys, counts in trie.take(most):
            waiting.append((keys, counts))
            n += len(keys)
            if n >= 65_536:
                yield _run(words, *map(np.concatenate, zip(*waiting)), size)
                waiting, n = [], 0
        if waiting:
            yield _run(words, *map(np.concatenate, zip(*waiting)), size)

    def words_out() -> Iterator[pa.RecordBatch]:
        seen = np.flatnonzero(single)
        for at in range(0, len(seen), 65_536):
            yield _run(words, seen[at : at + 65_536], single[seen[at : at + 65_536]], 1)

    for batch in batches:
        for lang, data in _texts(batch):
            tail = np.zeros(size - 1, np.int64)
            for found in _parts(data):
                if words.full():
                    last = [words.names[k] for k in tail]
                    yield from spill(0)
                    yield from words_out()
                    words.clear()
                    trie, single = HatTrie(), np.zeros(0, np.int64)
                    tail = np.array([words.ids(lang, [w])[0] if w else 0 for w in last], np.int64)
                ids = words.ids(lang, found)
                grown = np.bincount(ids, minlength=len(words.names))
                if marked is None:
                    grown[0] = 0
                    totals[lang] += int(grown.sum())
                    grown[: len(single)] += single
                    single = grown
                line = np.concatenate([tail, ids])
                tail = line[len(line) - size + 1 :]
                parts = [line[k : len(line) - size + 1 + k] for k in range(size)]
                good = np.logical_and.reduce([p > 0 for p in parts])
                if marked is not None:
                    h = words.word_hashes()[line]
                    hit = is_marked(marked, _pair_places(h[:-1], h[1:], np.uint64(xxhash.xxh64_intdigest(lang, 42)), len(marked) * 8))
                    good &= np.logical_and.reduce([hit[k : len(hit) - size + 2 + k] for k in range(size - 1)])
                key = parts[0][good]
                for p in parts[1:]:
                    key = key << BITS | p[good]
                trie.add(key)
                if trie.size > entries:
                    yield from spill(entries // 2)
    yield from spill(0)
    yield from words_out()
    if totals:
        yield pa.RecordBatch.from_pydict({"lang": list(totals), "phrase": [""] * len(totals), "f": list(totals.values())}, schema=RUN_SCHEMA)


def _pair_places(a: np.ndarray, b: np.ndarray, lang: np.uint64, bits: int) -> np.ndarray:
    return (((a << np.uint64(7)) | (a >> np.uint64(57))) ^ b ^ lang) & np.uint64(bits - 1)


def pair_table(pairs: DataFrame, most_bits: int = 1 << 26) -> bytes:
    """Bits of the (lang, w1, w2) rows."""
    a, b, lang = (F.xxhash64(c) for c in ("w1", "w2", "lang"))
    mixed = F.shiftleft(a, 7).bitwiseOR(F.shiftrightunsigned(a, 57)).bitwiseXOR(b).bitwiseXOR(lang)
    return bit_table(pairs, lambda bits: mixed.bitwiseAND(F.lit(bits - 1)), most_bits)


def counted(docs: DataFrame, size: int, pairs: bytes | None = None, entries: int = 400_000, most_words: int = 500_000, most_bytes: int = 64 << 20) -> DataFrame:
    """(lang, phrase, f): of n-grams of ``size`` words; see ``_count``."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    sent = None if pairs is None else docs.sparkSession.sparkContext.broadcast(pairs)
    runs = map_batches(texts, lambda b: _count(b, size, None if sent is None else sent.value, entries, most_words, most_bytes), "lang string, phrase string, f long")
    # the tries have added up what a task has, so rows go to their partitions before Spark adds
    return runs.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly."""
    wide = lambda c: c.cast("decimal(38,0)")
    top = F.lit(1_000_000).cast("decimal(38,0)") * wide(a) * wide(a)
    return F.call_function("div", top, wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, absorbed: int = 50, salts: int = 256) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of two or three words
    that occur ``least`` times; one goes if a longer candidate around it has ``absorbed`` percent of its count."""
    short = materialize(counted(docs, 2).where((F.col("f") >= least) | (F.col("phrase") == "")), "phrases-short")
    cut = F.split("phrase", " ")
    words = short.where(~F.contains("phrase", F.lit(" ")) & (F.col("phrase") != "")).select("lang", F.col("phrase").alias("w"), F.col("f").alias("fw"))
    pairs = short.where(F.contains("phrase", F.lit(" "))).select("lang", "phrase", cut[0].alias("w1"), cut[1].alias("w2"), F.col("f").alias("a"))
    totals = short.where("phrase = ''").select("lang", F.col("f").alias("n"))
    triples = counted(docs, 3, pair_table(pairs)).where((F.col("f") >= least) & (F.col("phrase") != ""))
    triples = materialize(triples.select("lang", "phrase", cut[0].alias("w1"), F.concat_ws(" ", cut[0], cut[1]).alias("w12"), F.concat_ws(" ", cut[1], cut[2]).alias("w23"), cut[2].alias("w3"), F.col("f").alias("a")), "phrases-triples")

    def of(df: DataFrame, what: DataFrame, key: str, at: str, f: str, name: str) -> DataFrame:
        return df.join(what.select("lang", F.col(key).alias(at), F.col(f).alias(name)), ["lang", at])

    two = of(of(pairs, words, "w", "w1", "fw", "l"), words, "w", "w2", "fw", "r").select("lang", "phrase", "a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    around = triples.select("lang", F.explode(F.array("w12", "w23")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    two = two.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < absorbed * F.col("a"))).drop("around")
    three = of(of(triples, words, "w", "w1", "fw", "l1"), pairs, "phrase", "w23", "a", "r1")
    three = of(of(three, pairs, "phrase", "w12", "a", "l2"), words, "w", "w3", "fw", "r2")
    one, other = (F.struct(score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2))
    three = three.withColumn("low", F.least(one, other)).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    return _ranked(two.unionByName(three), totals, top, salts)


def _ranked(found: DataFrame, totals: DataFrame, top: int, salts: int) -> DataFrame:
    """The first ``top`` of each lang. Rows are dealt over salts, ``top`` of each stay. What comes after
    the last of all salts' first top / salts rows has ``top`` rows before it, so only about ``top`` rows
    of a lang meet in the end, however many it has."""
    order = F.struct((-F.col("score")).alias("s"), (-F.col("a")).alias("a"), "phrase")
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("order", order)
    dealt = dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("order"))).where(F.col("place") <= top)
    dealt = materialize(dealt, "phrases-tops")
    worst = dealt.where(F.col("place") == -(-top // salts)).groupBy("lang").agg(F.max("order").alias("worst"), F.count("*").alias("m"))
    # every salt is told: a lang's rows meet only once few are left
    told = worst.where(F.col("m") == salts).select("lang", "worst", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    near = dealt.join(told, ["lang", "salt"], "left").where(F.col("worst").isNull() | (F.col("order") <= F.col("worst")))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(x, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)
), t AS (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p)
), f1 AS (SELECT lang, w1 AS w, count(*) AS f FROM t GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM t WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
c2 AS (
  SELECT f2.lang, w1 || ' ' || w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, (1000000::HUGEINT * f2.f * f2.f) // (x.f::HUGEINT * y.f) AS score
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w = w1 JOIN f1 y ON y.lang = f2.lang AND y.w = w2 WHERE f2.f >= 10
), c3 AS (
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
         (1000000::HUGEINT * f3.f * f3.f) // (x.f::HUGEINT * yz.f) AS s1, (1000000::HUGEINT * f3.f * f3.f) // (xy.f::HUGEINT * z.f) AS s2
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w = f3.w1 JOIN f1 z ON z.lang = f3.lang AND z.w = f3.w3
  JOIN f2 xy ON xy.lang = f3.lang AND xy.w1 = f3.w1 AND xy.w2 = f3.w2 JOIN f2 yz ON yz.lang = f3.lang AND yz.w1 = f3.w2 AND yz.w2 = f3.w3
), around AS (
  SELECT lang, phrase, max(f) AS f FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL
), c AS (
  SELECT c2.lang, c2.phrase, a, l, r, score FROM c2 LEFT JOIN around o ON o.lang = c2.lang AND o.phrase = c2.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * a
  UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM c JOIN n USING (lang) QUALIFY rank <= 2000
"""
