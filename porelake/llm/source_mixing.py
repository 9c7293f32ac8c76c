"""Operator 8: mixing sources to target weights, with DataFrame operations only.

Temperature mixing: a source with token share p gets weight p ** t, normalised. The exponent t >= 0
is found by bisection (``SECTIONS`` points a round). For a target entropy it is the largest exponent
whose weights still have it: the entropy falls as t grows, from that of equal weights at 0 through the
natural one at 1, so the search first doubles t until the entropy is below the target. For a limit
on repeats it is the smallest exponent in [0, 1] that repeats no source more often. The weights are
then realised within a token budget: each source is dealt in blocks, every block a permutation of all
its documents, and the last one is cut where the source's quota is used up. By default the budget is
the smallest one at which every document is used.

Permutations order documents by md5(doc_id:block:seed), so they can be computed anywhere. Where the
last block is cut is found from sums per (source, leading digits of the key) and one narrow range of
keys; no task ever holds a source, and a source with a third of all rows is many ranges. What is
joined to the documents is one row per source, a written table that Spark broadcasts only if small.

Tokens are counted as spaces + 1; null and empty texts have none. Defined results: a null source is
the source ''. Sources without tokens get one block and no weight. Repeated rows count one by one
and share their place in the order. Documents with equal keys are cut together. Very long texts are
counted in the JVM and never leave their row. An empty table gives no rows. Further columns, whatever
their names, are ignored by the plan and kept by ``mixed``.

A target that no exponent meets is an error: an entropy share outside [0, 1], an entropy at or below
that of equal weights of the largest sources (the limit for large t), a limit on repeats under 1.
Where all sources with tokens have equal shares, or there is one, every exponent gives the same
weights, and these are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from porelake.llm._shared import materialize, quoted, table

SECTIONS, ROUNDS, EPS = 32, 6, 1e-9
DOUBLINGS = 41  # exponents up to 2 ** 40
DIGITS = 3  # of the order key: 4096 ranges of a block


def source_key() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def order_key(block: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), block.cast("string"), F.lit(str(seed))))


def token_count() -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def _at_exponents(shares: DataFrame, exponents: Column) -> DataFrame:
    """One row per exponent t of the array: k (its place), entropy of the weights, sources, and how
    much more often the most repeated source is used than the least repeated one. Powers are taken
    of p / max(p), so none of the sums vanishes at large t."""
    at = shares.select("r", F.posexplode(exponents).alias("k", "t")).withColumn("u", F.col("t") * F.ln("r")).withColumn("w", F.exp("u"))
    sums = at.groupBy("k", "t").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("u")).alias("wu"), F.max(F.col("w") / F.col("r")).alias("most"), F.min(F.col("w") / F.col("r")).alias("fewest"), F.count("*").alias("n"))
    return sums.select("k", "t", (F.ln("z") - F.col("wu") / F.col("z")).alias("entropy"), (F.col("most") / F.col("fewest")).alias("repeats"), "n")


def _spread(lo: float, hi: float) -> Column:
    return F.array(*[F.lit(lo + (hi - lo) * k / SECTIONS) for k in range(SECTIONS + 1)])


def _exponent(shares: DataFrame, entropy_share: float | None, max_repeats: float | None) -> float:
    """shares: (r) p / max(p) of the sources that have tokens."""
    found = shares.agg(F.count("*").alias("n"), F.min("r").alias("least"), F.count_if(F.col("r") == 1).alias("largest")).first()
    if entropy_share is None:
        if max_repeats is None or max_repeats < 1:
            raise ValueError(f"no weights repeat every source at most {max_repeats} times as often as another")
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            k = _at_exponents(shares, _spread(lo, hi)).where(F.col("repeats") <= max_repeats + EPS).agg(F.min("k")).first()[0]
            k = SECTIONS if k is None else k  # the first point within the limit
            lo, hi = lo + (hi - lo) * max(k - 1, 0) / SECTIONS, lo + (hi - lo) * k / SECTIONS
        return hi
    if not 0 <= entropy_share <= 1:
        raise ValueError(f"an entropy share of {entropy_share} is outside [0, 1]")
    if found.least == 1:
        return 1.0
    target = entropy_share * math.log(found.n)
    if target <= math.log(found.largest) + EPS:
        raise ValueError(f"the {found.largest} largest of {found.n} sources alone have an entropy share of {math.log(found.largest) / math.log(found.n):.6f}; {entropy_share} is out of reach")
    doubled = F.array(*[F.lit(float(2**k)) for k in range(DOUBLINGS)])
    hi = _at_exponents(shares, doubled).where(F.col("entropy") < target - EPS).agg(F.min("t")).first()[0]
    if hi is None:
        raise ValueError(f"no exponent up to {2.0 ** (DOUBLINGS - 1):.0f} has an entropy share of {entropy_share}: the largest sources are too alike")
    lo = 0.0 if hi == 1 else hi / 2
    for _ in range(ROUNDS):
        k = _at_exponents(shares, _spread(lo, hi)).where(F.col("entropy") >= target - EPS).agg(F.max("k")).first()[0]
        k = 0 if k is None else k  # the last point that still has the entropy
        lo, hi = lo + (hi - lo) * k / SECTIONS, lo + (hi - lo) * min(k + 1, SECTIONS) / SECTIONS
    return lo


def mixing_plan(base: DataFrame, entropy_share: float | None = 0.9, max_repeats: float | None = None, budget: float | None = None) -> DataFrame:
    """(src, tokens, weight, blocks, rest): full blocks of each source and the tokens of its last one.

    ``entropy_share`` is the target entropy as a share of that of equal weights; give None and
    ``max_repeats`` (1 or more) to bound how often the most repeated source is used for each use of
    the least repeated one. ``budget`` is in tokens."""
    sources = materialize(base.groupBy("src").agg(F.sum("tokens").alias("tokens")), "mixing-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return materialize(sources.select("src", "tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("blocks"), F.lit(0.0).alias("rest")), "mixing-plan")
    largest = float(sources.agg(F.max("tokens")).first()[0])
    t = _exponent(sources.where("tokens > 0").select((F.col("tokens") / F.lit(largest)).alias("r")), entropy_share, max_repeats)
    power = F.when(F.col("tokens") > 0, F.exp(F.lit(t) * F.ln(F.col("tokens") / F.lit(largest)))).otherwise(0.0)
    z = sources.agg(F.sum(power)).first()[0]
    weighted = sources.withColumn("weight", power / F.lit(z))
    if budget is None:
        budget = weighted.where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0]
    used = F.col("weight") * F.lit(float(budget)) / F.when(F.col("tokens") > 0, F.col("tokens"))
    blocks = F.coalesce(F.floor(used + EPS), F.lit(1)).cast("long")
    rest = F.greatest(F.lit(0.0), F.coalesce(F.col("weight") * F.lit(float(budget)) - F.col("blocks") * F.col("tokens"), F.lit(0.0)))
    return materialize(weighted.withColumn("blocks", blocks).withColumn("rest", rest).select("src", "tokens", "weight", "blocks", "rest"), "mixing-plan")


def with_cuts(base: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The plan and ``cut``: the last block holds the documents whose order key is not above it."""
    keyed = base.join(plan.where("rest > 0").select("src", "blocks", "rest"), "src").withColumn("key", order_key(F.col("blocks"), seed)).withColumn("range", F.substring("key", 1, DIGITS))
    sums = materialize(keyed.groupBy("src", "range").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest")), "mixing-ranges")
    before = F.sum("n").over(Window.partitionBy("src").orderBy("range")) - F.col("n")  # at most 4096 rows a source
    reached = sums.withColumn("before", before)
    crossing = materialize(reached.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest"))).select("src", "range", "before"), "mixing-crossing")
    inside = keyed.join(crossing, ["src", "range"])
    running = F.col("before") + F.sum("tokens").over(Window.partitionBy("src", "range").orderBy("key"))
    last = inside.withColumn("running", running).where(F.col("running") <= F.col("rest")).groupBy("src").agg(F.max("key").alias("last"))
    cuts = crossing.join(last, "src", "left").select("src", F.coalesce("last", "range").alias("cut"))
    return materialize(plan.join(cuts, "src", "left"), "mixing-cuts")


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of docs has, whatever the case."""
    mark = "_mix"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    return [f"{mark}_{n}" for n in names]


def _blocks_of(docs: DataFrame, cuts: DataFrame, seed: int, src: str, block: str) -> DataFrame:
    """docs (with their source in ``src``) joined to the source's row; ``block``: one row per block
    that holds the document."""
    blocks, cut = _fresh(docs, "blocks", "cut")
    of_source = cuts.select(F.col("src").alias(src), F.col("blocks").alias(blocks), F.col("cut").alias(cut))
    partial = F.col(cut).isNotNull() & (order_key(F.col(blocks), seed) <= F.col(cut))
    uses = F.col(blocks) + F.when(partial, 1).otherwise(0)
    return docs.join(of_source, src).withColumn(block, F.explode(F.when(uses > 0, F.sequence(F.lit(0).cast("long"), uses - 1)).otherwise(F.array().cast("array<bigint>"))))


def _base(docs: DataFrame) -> DataFrame:
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("src"), token_count().alias("tokens")), "mixing-base")


def mixture(docs: DataFrame, seed: int = 7, **target) -> DataFrame:
    """(doc_id, source, block, place, n_tokens): every use of every document. ``place`` is its rank
    in the permutation that is its source's block; dealing blocks in order keeps the weights."""
    base = _base(docs)
    cuts = with_cuts(base, mixing_plan(base, **target), seed)
    rows = materialize(_blocks_of(base.withColumnRenamed("tokens", "n_tokens"), cuts, seed, "src", "block").withColumn("key", order_key(F.col("block"), seed)).select("doc_id", "src", "block", "n_tokens", "key", F.substring("key", 1, DIGITS).alias("range")), "mixing-rows")
    sizes = rows.groupBy("src", "block", "range").agg(F.count("*").alias("n"))
    first = materialize(sizes.withColumn("first", F.sum("n").over(Window.partitionBy("src", "block").orderBy("range")) - F.col("n")).drop("n"), "mixing-first")
    rank = F.rank().over(Window.partitionBy("src", "block", "range").orderBy("key"))
    return rows.join(first, ["src", "block", "range"]).withColumn("place", F.col("first") + rank).select("doc_id", F.col("src").alias("source"), "block", "place", "n_tokens")


def mixed(docs: DataFrame, seed: int = 7, **target) -> DataFrame:
    """The documents, all columns, as often as the mixture uses them; only one row per source is
    joined, texts are not shuffled."""
    base = _base(docs)
    cuts = with_cuts(base, mixing_plan(base, **target), seed)
    src, block = _fresh(docs, "src", "block")
    return _blocks_of(docs.withColumn(src, source_key()), cuts, seed, src, block).select(*[F.col(quoted(c)) for c in docs.columns])


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def mixing_sql(entropy_share: float) -> str:
    """The mixture in SQL, for a target entropy that some exponent meets."""
    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(source, '') AS src,
         CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS tokens
  FROM documents
), sources AS (
  SELECT src, CAST(sum(tokens) AS BIGINT) AS tokens FROM base GROUP BY src
), shares AS (
  SELECT src, tokens, tokens / (SELECT max(tokens) FROM sources)::DOUBLE AS r FROM sources WHERE tokens > 0
), target AS (
  SELECT {entropy_share}::DOUBLE * ln(count(*)::DOUBLE) AS h, min(r) = 1 AS alike FROM shares
), doubled AS (
  SELECT t, ln(sum(exp(t * ln(r)))) - sum(exp(t * ln(r)) * t * ln(r)) / sum(exp(t * ln(r))) AS entropy
  FROM shares, (SELECT pow(2.0::DOUBLE, k) AS t FROM range({DOUBLINGS}) AS r(k)) GROUP BY t
), bracket AS (
  SELECT CASE WHEN min(t) = 1 THEN 0 ELSE min(t) / 2 END AS lo, min(t) AS hi FROM doubled WHERE entropy < (SELECT h FROM target) - 1e-9
), bisect AS (
  SELECT 0 AS i, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM bracket
  UNION ALL
  SELECT i + 1, lo + (hi - lo) * k / {SECTIONS}, lo + (hi - lo) * least(k + 1, {SECTIONS}) / {SECTIONS}
  FROM (
    SELECT i, lo, hi, coalesce(max(k) FILTER (ln(z) - wu / z >= (SELECT h FROM target) - 1e-9), 0) AS k
    FROM (
      SELECT i, lo, hi, k, sum(exp(u)) AS z, sum(exp(u) * u) AS wu
      FROM (SELECT i, lo, hi, k, (lo + (hi - lo) * k / {SECTIONS}.0::DOUBLE) * ln(r) AS u
            FROM bisect, range({SECTIONS + 1}) AS s(k), shares WHERE i < {ROUNDS})
      GROUP BY i, lo, hi, k)
    GROUP BY i, lo, hi)
), weights AS (
  SELECT src, tokens, exp(t * ln(r)) / sum(exp(t * ln(r))) OVER () AS weight
  FROM shares, (SELECT CASE WHEN (SELECT alike FROM target) THEN 1 ELSE max(lo) END AS t FROM bisect WHERE i = {ROUNDS})
), plan AS (
  SELECT src, tokens, weight * b AS quota, CAST(floor(weight * b / tokens + 1e-9) AS BIGINT) AS blocks
  FROM weights, (SELECT max(tokens / weight) AS b FROM weights)
  UNION ALL SELECT src, tokens, 0, 1 FROM sources WHERE tokens = 0
), cut AS (
  SELECT doc_id, src, blocks, tokens, quota,
         sum(n) OVER (PARTITION BY src ORDER BY md5(doc_id || ':' || blocks || ':7')) AS running
  FROM (SELECT doc_id, src, base.tokens AS n, plan.tokens AS tokens, quota, blocks FROM base JOIN plan USING (src))
), uses AS (
  SELECT doc_id, src, unnest(range(blocks + CASE WHEN quota - blocks * tokens > 0 AND running <= quota - blocks * tokens THEN 1 ELSE 0 END)) AS block
  FROM cut
)
SELECT doc_id, src AS source, block,
       rank() OVER (PARTITION BY src, block ORDER BY md5(doc_id || ':' || block || ':7')) AS place,
       CAST(n AS BIGINT) AS n_tokens
FROM uses JOIN (SELECT doc_id, src, tokens AS n FROM base) USING (doc_id, src)
"""


ORACLE_SQL = mixing_sql(0.9)
