"""Operator 12: hard-negative mining by Kronecker-packed products.

Rows are dealt evenly over shards, anchors over groups; each pair of them meets in one task, twice.
The first pass finds each anchor's best rows of its own label, the second one, within the scores that
these positives allow, the best rows of other labels. Short lists merge over shards in a tree.

In a task several candidates share one wide integer: a bias makes their components positive, each
candidate has a field of bits of its own, and one product with an anchor's component serves all of
them. The sum over components is unpacked by shifts; an offset keeps every field positive and the
bias's part is taken off again, so scores are exact. A double carries integers of 53 bits, which a
matrix product of doubles then adds exactly; where two fields do not fit, Python's integers carry
``WIDE`` fields of any width. Widths follow from the components at hand.

Defined results: components become floor(scale * x), x as double. Rows with a null vec_id, label or
vector, or with a null or non-finite component, take no part; nor do vectors of other lengths than the
anchor's. ``Other`` rows are those of another vec_id; repeated rows are candidates one by one, and a
repeated anchor has its own lists (its result rows repeat). Ties go to the smaller vec_id. Empty vectors
score 0. A score beyond 64 bits, or a component beyond a double, is an error. Very wide vectors make smaller
shards and groups. An empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from porelake.llm._shared import materialize, table

CARRIED, WIDE = 53, 16  # bits of a double's integer; fields of one of Python's integers
LOW = np.iinfo(np.int64).min


def field_bits(anchors: np.ndarray, candidates: np.ndarray) -> tuple[int, int]:
    """(bias, bits of a field) so that no sum of products leaves its field."""
    bias = int(-min(0.0, candidates.min(initial=0.0)))
    most = int(np.abs(anchors).max(initial=0.0)) * (int(max(0.0, candidates.max(initial=0.0))) + bias) * anchors.shape[1]
    return bias, most.bit_length() + 1


class Packed:
    """Candidates, several to an integer; ``scores`` gives the exact products with anchors."""

    def __init__(self, candidates: np.ndarray, bias: int, width: int):
        self.n, self.bias, self.width = len(candidates), bias, width
        self.exact = CARRIED // width >= 2
        self.fields = CARRIED // width if self.exact else WIDE
        self.groups = -(-self.n // self.fields)
        kind = np.float64 if self.exact else object
        self.words = np.zeros((self.groups, candidates.shape[1]), kind)
        for i in range(self.fields):  # field i holds the i-th run of candidates
            part = candidates[i * self.groups : (i + 1) * self.groups]
            part = part if self.exact else np.frompyfunc(int, 1, 1)(part)
            self.words[: len(part)] += (part + bias) * (1 << (width * i))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """(anchors, candidates) as 64-bit integers; a larger one is an error."""
        half, mask = 1 << (self.width - 1), (1 << self.width) - 1
        offset = sum(half << (self.width * i) for i in range(self.fields))
        out = np.empty((len(anchors), self.fields * self.groups), np.int64)
        if self.exact:
            total = (anchors @ self.words.T).astype(np.int64) + offset
            taken = half + self.bias * anchors.sum(axis=1).astype(np.int64)[:, None]
        else:
            whole = np.frompyfunc(int, 1, 1)(anchors)
            total = np.dot(whole, self.words.T) + offset
            taken = half + self.bias * whole.sum(axis=1, initial=0)[:, None]
        for i in range(self.fields):
            field = (total >> (self.width * i)) & mask
            found = field - taken
            if not self.exact and found.size and (found.max() > np.iinfo(np.int64).max or found.min() <= LOW):
                raise OverflowError("a score needs more than 64 bits")
            out[:, i * self.groups : (i + 1) * self.groups] = found
        return out[:, : self.n]


def first_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k highest allowed scores, ties to the left: (row, column) by row and rank."""
    masked = np.where(allowed, scores, LOW)
    rows = np.flatnonzero(allowed.any(axis=1))
    masked, n = masked[rows], scores.shape[1]
    if n > k:
        least = np.partition(masked, n - k, axis=1)[:, n - k]
        row, col = np.nonzero((masked >= least[:, None]) & (masked > LOW))
    else:
        row, col = np.nonzero(masked > LOW)
    order = np.lexsort((col, -masked[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return rows[row[keep]], col[keep]


def _matrix(col: pa.ChunkedArray, rows: np.ndarray, dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((len(rows), 0))
    return col.combine_chunks().take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(shard: pa.Table, anchors: pa.Table, block: int = 128, tile: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of anchors, rows of the shard by vec_id, scores) of every block and tile."""
    s_dim, a_dim = (t["v"].combine_chunks().value_lengths().to_numpy() if t.num_rows else np.zeros(0, int) for t in (shard, anchors))
    s_id = shard["vec_id"].to_numpy()
    for dim in np.intersect1d(s_dim, a_dim):
        at, ask = np.flatnonzero(s_dim == dim), np.flatnonzero(a_dim == dim)
        at = at[np.argsort(s_id[at], kind="stable")]
        base, want = _matrix(shard["v"], at, dim), _matrix(anchors["v"], ask, dim)
        bias, width = field_bits(want, base)
        for t in range(0, len(at), tile):
            packed = Packed(base[t : t + tile], bias, width)
            for b in range(0, len(ask), block):
                yield ask[b : b + block], at[t : t + tile], packed.scores(want[b : b + block])


def _table(found: list[tuple], names: list[str]) -> pa.Table:
    parts = [np.concatenate(x).astype(np.int64) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * len(names)
    return pa.table({n: pa.array(p, pa.int64()) for n, p in zip(names, parts)})


def _positives(shard: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    s_id, s_label, a_id, a_label, a_row = (t[c].to_numpy() for t, c in ((shard, "vec_id"), (shard, "label"), (anchors, "vec_id"), (anchors, "label"), (anchors, "anchor_row")))
    number, found = shard["shard"][0].as_py() if shard.num_rows else 0, []
    for ask, at, scores in _blocks(shard, anchors):
        same = (a_label[ask][:, None] == s_label[at][None]) & (a_id[ask][:, None] != s_id[at][None])
        row, col = first_of(scores, same, k)
        found.append((a_row[ask[row]], a_id[ask[row]], np.full(len(row), number), s_id[at[col]], scores[row, col]))
    return _table(found, ["anchor_row", "anchor_id", "shard", "positive_id", "positive_score"])


def _negatives(shard: pa.Table, anchors: pa.Table, k: int, least: int, most: int) -> pa.Table:
    s_id, s_label, a_label, a_row = (t[c].to_numpy() for t, c in ((shard, "vec_id"), (shard, "label"), (anchors, "label"), (anchors, "anchor_row")))
    number, found = shard["shard"][0].as_py() if shard.num_rows else 0, []
    bounds = [[(-(-least * p // 100), most * p // 100) for p in ps] for ps in anchors["positives"].to_pylist()]  # Python's integers: no overflow
    for ask, at, scores in _blocks(shard, anchors):
        other = a_label[ask][:, None] != s_label[at][None]
        for place in range(max((len(bounds[a]) for a in ask), default=0)):
            mine = np.array([r for r, a in enumerate(ask) if len(bounds[a]) > place])
            lo, hi = (np.array([bounds[ask[r]][place][e] for r in mine])[:, None] for e in (0, 1))
            part = scores[mine]
            row, col = first_of(part, other[mine] & (part >= lo) & (part <= hi), k)
            found.append((a_row[ask[mine[row]]], np.full(len(row), place), np.full(len(row), number), s_id[at[col]], part[row, col]))
    return _table(found, ["anchor_row", "place", "shard", "negative_id", "negative_score"])


def integer_rows(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v array<double> of integers) of the rows that take part; every seventh vec_id's
    label is moved on by one of ten."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = lambda e: F.when(F.abs(e * scale) < F.lit(2.0**53), F.floor(e * scale).cast("double")).otherwise(e * scale)  # noqa: E731  larger doubles are integers
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(x, whole).alias("v"))


def mined(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, shard_rows: int = 16384, group_rows: int = 65536, fan: int = 8, most_cells: int = 1 << 22) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): of each anchor's
    positives the best negatives whose score is ``least`` to ``most`` percent of the positive's."""
    rows = materialize(integer_rows(vectors), "negatives-rows")
    anchors = materialize(rows.where(is_anchor).withColumn("anchor_row", F.monotonically_increasing_id()), "negatives-anchors")
    width, n_rows = rows.agg(F.max(F.size("v")), F.count("*")).first()
    shard_rows, group_rows = (max(1, min(n, most_cells // max(1, width or 1))) for n in (shard_rows, group_rows))
    shards, groups = max(1, -(-n_rows // shard_rows)), max(1, -(-anchors.count() // group_rows))
    # dealt by the position in a written table, so that neither a frequent label nor a frequent id gathers anywhere
    dealt = rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = ["shard", "part"]

    def ask(df: DataFrame, run, schema: str) -> DataFrame:
        to_all = df.withColumn("part", F.pmod("anchor_row", F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        return dealt.groupBy(*keys).cogroup(to_all.groupBy(*keys)).applyInArrow(run, schema)

    def merge(lists: DataFrame, by: list[str], score: str, other: str, k: int) -> DataFrame:
        left = shards
        while True:
            w = Window.partitionBy(*by, *(["shard"] if left > 1 else [])).orderBy(F.col(score).desc(), F.col(other))
            left = -(-left // fan) if left > 1 else 0
            if not left:
                return lists.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).drop("shard")
            lists = lists.withColumn("shard", F.floor(F.col("shard") / fan))
            lists = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")

    good = merge(ask(anchors, lambda s, a: _positives(s, a, positives), "anchor_row long, anchor_id long, shard long, positive_id long, positive_score long"), ["anchor_row"], "positive_score", "positive_id", positives)
    good = materialize(good.withColumn("place", (F.col("rank") - 1).cast("long")).drop("rank"), "negatives-positives")
    lists = good.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # at most ``positives`` an anchor
    with_lists = anchors.join(lists.select("anchor_row", F.transform("p", lambda p: p["positive_score"]).alias("positives")), "anchor_row")
    bad = merge(ask(with_lists, lambda s, a: _negatives(s, a, negatives, least, most), "anchor_row long, place long, shard long, negative_id long, negative_score long"), ["anchor_row", "place"], "negative_score", "negative_id", negatives)
    return good.join(bad, ["anchor_row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
