"""Operator 3: quality rules of documents and of their hosts.

One pass over the documents measures each text and applies the rules to it. Failures are then
counted per host and rule; a host's failure rate is shrunk towards the rate of all hosts by a beta
prior whose parameters are fitted to the hosts' rates, so that a few bad documents do not condemn a
small host. Verdicts on hosts are joined back to the documents.

Hosts are summed before they are shuffled, so a host with a third of all documents is one row per
task. The verdicts are a written table, which Spark broadcasts only if its files are small; else it
joins by shuffle and splits skewed partitions (AQE).

Defined results: a null text has no words; words are runs of anything but the six ASCII white-space
characters. A null host is a host of its own. Repeated rows, a null doc_id too, count one by one. A
very long text costs some 100 bytes a word while it is measured, most of them for its words. Hosts at
the limit stay. An empty table gives no rows. Further columns, whatever their names, are ignored by
the measures and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from porelake.llm._shared import map_batches, materialize, quoted, table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words in windows that occur twice or more. Windows get numbers, equal ones the same: those of
    length 1, 2, 4, ... and from them those of ``window``; all in arrays."""
    n = len(words) - window + 1
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if n < 2 or len(number) == len(words):
        return 0
    length = 1
    while length < window:
        step = min(length, window - length)
        left, right = ids[: len(words) - length - step + 1], ids[step:]
        ids = np.unique(left * (right.max() + 1) + right, return_inverse=True)[1]
        length += step
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, twice, 1)
    np.subtract.at(inside, twice + window, 1)
    return int((np.cumsum(inside) > 0).sum())


def measure(text: str, window: int = 5) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.encode("utf-8", "replace").split()  # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else []
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words, window)


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, counts) of each document: one pass, no shuffle."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t.as_py() or "") for t in b.column("text")]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "host": b.column("host"), **{c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(COUNTS)}})

    return map_batches(chosen, run, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def with_failures(rows: DataFrame) -> DataFrame:
    """The rules: base_failed decides on a document by itself, the others only count for its host."""
    short, repeated = F.col("n_words") < 10, 100 * F.col("n_repeat_words") > 20 * F.col("n_words")
    return (
        rows.withColumn("fails_short", short)
        .withColumn("fails_repeats", repeated)
        .withColumn("fails_symbols", 10 * F.col("n_symbols") > F.col("word_chars"))
        .withColumn("fails_lines", 5 * F.col("n_dup_lines") > F.col("n_words"))
        .withColumn("base_failed", short | repeated)
    )


RULES = ("fails_short", "fails_repeats", "fails_symbols", "fails_lines")


def host_verdicts(rows: DataFrame, limit: float = 0.5, rules: tuple[str, ...] = RULES) -> DataFrame:
    """(host, rule, n, failures, rate, rejected): the shrunk failure rate of each host and rule.

    The prior is beta with mean m, that of the hosts' raw rates, and strength (1 - c) / c, where c is
    the correlation of failures within a host. The rates' variance is m (1 - m) (c + (1 - c) a), a
    being the mean of 1 / n: what n draws scatter by themselves is part of it, and is taken out here.
    c is kept within [0, 1]: at 0 the hosts differ no more than draws do, and all have the rate m; at
    1 their raw rates stay. If every host has one document, c is 0."""
    per_host = rows.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in rules])
    tall = per_host.select("host", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failures")) for r in rules])).alias("x")).select("host", "n", "x.rule", "x.failures")
    raw = F.col("failures") / F.col("n")
    moments = tall.groupBy("rule").agg(F.avg(raw).alias("m"), F.coalesce(F.var_samp(raw), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n")).alias("a"))
    spread = F.col("m") * (1 - F.col("m"))
    c = F.when((spread > 0) & (F.col("a") < 1), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") / spread - F.col("a")) / (1 - F.col("a"))))).otherwise(F.lit(0.0))
    rate = (F.col("c") * F.col("failures") + (1 - F.col("c")) * F.col("m")) / (F.col("c") * F.col("n") + (1 - F.col("c")))
    return tall.join(F.broadcast(moments.withColumn("c", c)), "rule").select("host", "rule", "n", "failures", rate.alias("rate"), (rate > limit).alias("rejected"))  # moments: one row per rule


def judged(docs: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """(doc_id, counts, base_failed, host_rejected, kept) of each document."""
    rows = with_failures(materialize(measured(docs, host), "quality-measures"))
    bad = materialize(host_verdicts(rows, limit).where("rejected").groupBy("host").agg(F.count("*").alias("n_rules")), "quality-hosts")
    at = rows.alias("d").join(bad.alias("h"), F.col("d.host").eqNullSafe(F.col("h.host")), "left")
    rejected = F.col("h.n_rules").isNotNull()
    return at.select("d.doc_id", *[f"d.{c}" for c in COUNTS], "d.base_failed", rejected.alias("host_rejected"), (~F.col("d.base_failed") & ~rejected).alias("kept"))


def keep_good(docs: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """The documents, all columns, without those that a rule or their host's verdict rejects.

    One pass measures the documents and writes them beside their host and failures, whole if they
    pass their own rules; the hosts' verdicts are then joined to these rows, so a repeated doc_id
    does no harm."""
    own = "_quality"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    fields = docs.schema.fields
    carried = StructType([*[StructField(f"{own}_{k}", f.dataType) for k, f in enumerate(fields)], StructField("host", StringType()), *[StructField(c, LongType()) for c in COUNTS]])
    text = docs.schema.names.index("text")
    rows = docs.select(*[F.col(quoted(c)).alias(f"{own}_{k}") for k, c in enumerate(docs.columns)], F.col(quoted(host)).cast("string").alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.array([measure(t.as_py() or "") for t in b.column(text)], np.int64).reshape(-1, len(COUNTS))
            bad = pa.array((counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0]))
            whole = [pc.if_else(bad, pa.scalar(None, c.type), c) if k == text else c for k, c in enumerate(b.columns[:-1])]
            yield pa.record_batch([*whole, b.column("host"), *(pa.array(counts[:, k]) for k in range(len(COUNTS)))], names=carried.names)

    rows = with_failures(materialize(map_batches(rows, run, carried), "quality-rows"))
    bad = materialize(host_verdicts(rows, limit).where("rejected").select(F.col("host").alias("bad_host")).distinct(), "quality-hosts")
    good = rows.where(~F.col("base_failed"))
    return good.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left_anti").select(*[F.col(f"{own}_{k}").alias(c) for k, c in enumerate(docs.columns)])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows), range(5) AS t(k)
  WHERE n > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), tall AS (
  SELECT source, count(*) AS n, unnest([
    struct_pack(rule := 1, failures := count(*) FILTER (n_words < 10)),
    struct_pack(rule := 2, failures := count(*) FILTER (100 * n_repeat_words > 20 * n_words)),
    struct_pack(rule := 3, failures := count(*) FILTER (10 * n_symbols > word_chars)),
    struct_pack(rule := 4, failures := count(*) FILTER (5 * n_dup_lines > n_words))]) AS x
  FROM f GROUP BY source
), moments AS (
  SELECT x.rule AS rule, avg(x.failures / n) AS m, coalesce(var_samp(x.failures / n), 0) AS v, avg(1 / n) AS a FROM tall GROUP BY x.rule
), prior AS (
  SELECT rule, m, CASE WHEN m > 0 AND m < 1 AND a < 1 THEN greatest(0.0, least(1.0, (v / (m * (1 - m)) - a) / (1 - a))) ELSE 0.0 END AS c FROM moments
), bad AS (
  SELECT DISTINCT source FROM tall JOIN prior ON x.rule = rule WHERE (c * x.failures + (1 - c) * m) / (c * n + (1 - c)) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.source IS NOT DISTINCT FROM f.source) AS kept
FROM f
"""
