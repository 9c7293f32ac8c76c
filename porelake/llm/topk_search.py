"""Operator 1: exact top-k search by tiled matrix products.

The vectors are dealt evenly over shards of about ``tile_rows`` rows, the queries over groups of at
most ``query_group`` rows; each (shard, query group) pair meets in one task. The task multiplies
query blocks with its shard, keeps the k best of each tile (partial selection), and the short lists
of a query then merge in a tree: lists of ``fan`` neighbouring shards at a time until one is left.

Defined results: components become floor(1024 * x), x as double. Null vectors, and those holding
null or non-finite components, take no part. Candidates are all rows whose vec_id differs from the
query's and whose vector has the same length. Rows without vec_id take no part. Repeated rows are
candidates one by one; a repeated query row gets a list of its own. An empty table gives no rows. Ties go to the smaller vec_id. Products are exact: in doubles as
long as no sum can reach 2**53, else in 64-bit integers; where the largest components of a shard and
its queries allow a sum of 2**63, an error is raised. Very wide vectors make smaller shards. Empty
vectors score 0. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from porelake.llm._shared import materialize, table

PART_SCHEMA = "query_row long, query_id long, shard long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    big = float("inf")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(big)))
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _matrix(col: pa.ChunkedArray, rows: np.ndarray, dim: int) -> np.ndarray:
    flat = col.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if len(rows) == len(flat) else flat.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest scores, ties to the left: (row, column) sorted by row, then rank."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        row, col = np.nonzero(scores >= least[:, None])
    else:
        row, col = np.nonzero(np.ones(scores.shape, bool))
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    return row[keep], col[keep]


def _search_tile(shard: pa.Table, queries: pa.Table, k: int, block: int = 256, tile: int = 8192) -> pa.Table:
    """Top lists of each query over one shard; the tiles of a shard are merged as they come."""
    found = []
    s_dim = shard["v"].combine_chunks().value_lengths().to_numpy() if shard.num_rows else np.zeros(0, int)
    q_dim = queries["v"].combine_chunks().value_lengths().to_numpy() if queries.num_rows else np.zeros(0, int)
    s_id, q_id, q_row = (t[c].to_numpy() for t, c in ((shard, "vec_id"), (queries, "vec_id"), (queries, "query_row")))
    number = shard["shard"][0].as_py() if shard.num_rows else 0
    for dim in np.intersect1d(s_dim, q_dim):
        at, ask = np.flatnonzero(s_dim == dim), np.flatnonzero(q_dim == dim)
        at = at[np.argsort(s_id[at], kind="stable")]
        base, want = _matrix(shard["v"], at, dim) if dim else np.zeros((len(at), 0), np.int64), _matrix(queries["v"], ask, dim) if dim else np.zeros((len(ask), 0), np.int64)
        if dim and len(at) == shard.num_rows:
            base = base[at]
        most = [max(1, int(m.max(initial=0)), -int(m.min(initial=0))) for m in (base, want)]  # Python's integers
        top = most[0] * most[1] * max(1, int(dim))
        if top >= 2**63:
            raise OverflowError("a score may need more than 64 bits")
        exact = np.float64 if top < 2**53 else np.int64
        base, want, ids = base.astype(exact), want.astype(exact), s_id[at]
        low = -np.inf if exact is np.float64 else np.iinfo(np.int64).min
        for b in range(0, len(ask), block):
            qs, q_ids = want[b : b + block], q_id[ask[b : b + block]]
            best_s, best_i = np.empty((len(qs), 0), exact), np.empty((len(qs), 0), np.int64)
            for t in range(0, len(at), tile):
                part = ids[t : t + tile]
                scores = qs @ base[t : t + tile].T
                lo, hi = np.searchsorted(part, q_ids), np.searchsorted(part, q_ids, "right")
                for r in np.flatnonzero(hi > lo):
                    scores[r, lo[r] : hi[r]] = low
                row, col = _best(scores, k)
                width = np.bincount(row, minlength=len(qs)).max(initial=0)
                new_s, new_i = np.full((len(qs), width), low, exact), np.full((len(qs), width), -1, np.int64)
                place = np.arange(len(row)) - np.searchsorted(row, row)
                new_s[row, place], new_i[row, place] = scores[row, col], part[col]
                both_s, both_i = np.hstack([best_s, new_s]), np.hstack([best_i, new_i])  # earlier tiles hold smaller ids
                row, col = _best(both_s, k)
                width = np.bincount(row, minlength=len(qs)).max(initial=0)
                best_s, best_i = np.full((len(qs), width), low, exact), np.full((len(qs), width), -1, np.int64)
                place = np.arange(len(row)) - np.searchsorted(row, row)
                best_s[row, place], best_i[row, place] = both_s[row, col], both_i[row, col]
            row, col = np.nonzero(best_s != low)
            found.append((q_row[ask[b + row]], q_ids[row], best_i[row, col], best_s[row, col].astype(np.int64)))
    parts = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [()] * 4)]
    n = len(parts[0])
    return pa.table({"query_row": pa.array(parts[0], pa.int64()), "query_id": pa.array(parts[1], pa.int64()), "shard": pa.array(np.full(n, number, np.int64)), "vec_id": pa.array(parts[2], pa.int64()), "score": pa.array(parts[3], pa.int64())})


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, tile_rows: int = 16384, query_group: int = 65536, fan: int = 8, most_cells: int = 1 << 22) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query row. Wide vectors make
    smaller shards and groups of queries: neither holds more than ``most_cells`` components."""
    rows = integer_vectors(vectors)
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    tile_rows, query_group = (max(1, min(n, most_cells // width)) for n in (tile_rows, query_group))
    queries = materialize(rows.where(is_query).withColumn("query_row", F.monotonically_increasing_id()), "topk-queries")
    counts = rows.agg(F.count("*").alias("n")).first().n, queries.count()
    shards, groups = (max(1, -(-n // size)) for n, size in zip(counts, (tile_rows, query_group)))
    # dealt by position, so that neither a frequent vector nor a frequent id gathers anywhere
    dealt = rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = queries.withColumn("part", F.pmod(F.col("query_row"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    keys = ["shard", "part"]
    lists = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(lambda s, q: _search_tile(s, q, k), PART_SCHEMA)
    best = [F.col("score").desc(), F.col("vec_id")]
    while shards > 1:  # the tree: each level merges the lists of `fan` shards
        shards = -(-shards // fan)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan))
        w = Window.partitionBy("query_row", "shard").orderBy(*best)
        lists = lists.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")
    w = Window.partitionBy("query_row").orderBy(*best)
    return lists.select("query_id", F.row_number().over(w).cast("int").alias("rank"), "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
