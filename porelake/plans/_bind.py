"""Which table stands for which entity: events are signals (a read is a user_id, in order of time),
event types their base labels, documents hold sequences, embeddings hold score rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASES = ["click", "error", "purchase", "signup", "view"]
N = len(BASES)
RANGE, OFFSET, DIGITISATION = 1467.6, 4.0, 8192.0

# The same in SQL; queries begin with it.
S = """WITH s AS (
  SELECT user_id AS read_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
         value AS current, CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS INTEGER) AS code
  FROM events)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, t, current, code)"""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    code = (F.array_position(F.array(*map(F.lit, BASES)), F.col("event_type")) - 1).cast("int")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("read_id"), (F.row_number().over(w) - 1).cast("long").alias("t"), F.col("value").alias("current"), code.alias("code"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq): what of a document's text spells bases."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


Q = "SELECT doc_id AS read_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents"


def mapped_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per read: the signal as DACs; its reference is the sequence of runs of equal labels,
    each mapped to the sample where the run starts."""
    s = signal(spark, sf_dir).withColumn("_new", F.coalesce((F.col("code") != F.lag("code").over(Window.partitionBy("read_id").orderBy("t"))), F.lit(True)))
    rows = s.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("t", "current", "code", "_new"))).alias("x"))
    starts = F.filter("x", lambda v: v["_new"])
    return rows.select(
        "read_id",
        F.transform("x", lambda v: F.round(v["current"] * 100).cast("int")).alias("dacs"),
        F.transform(starts, lambda v: v["code"].cast("smallint")).alias("reference"),
        F.concat(F.transform(starts, lambda v: v["t"].cast("int")), F.array(F.size("x"))).alias("ref_to_signal"),
    )


# mapped reads in SQL, on top of S
M = (
    S
    + """, runs AS (
  SELECT *, coalesce(code <> lag(code) OVER (PARTITION BY read_id ORDER BY t), true) AS opens FROM s
), m AS (
  SELECT read_id, list(CAST(round(current * 100) AS INTEGER) ORDER BY t) AS dacs,
         list(code ORDER BY t) FILTER (opens) AS reference,
         list_append(list(CAST(t AS INTEGER) ORDER BY t) FILTER (opens), CAST(count(*) AS INTEGER)) AS r2s,
         CAST(count(*) AS INTEGER) AS siglen
  FROM runs GROUP BY read_id)"""
)


def score_rows(spark: SparkSession, sf_dir: str, n: int = 60, steps: int = 10) -> DataFrame:
    """(read_id, t, scores): ten vectors in a row are the steps of a read; 60 of their 64 components
    are the transition scores of five bases."""
    return read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / steps).cast("long").alias("read_id"), (F.col("vec_id") % steps).cast("long").alias("t"), F.transform(F.slice("embedding", 1, n), lambda v: v.cast("double")).alias("scores"))
