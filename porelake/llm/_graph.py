"""Connected components of a graph that is held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porelake.llm._shared import materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, for the nodes of (a, b) edges.

    Each round hangs every node's larger neighbours on its smallest one, then every node's smaller
    neighbours likewise (the alternation of large and small stars), until the edges are stars. The
    smallest neighbour comes from a partial aggregate; hubs are split by Spark's skew joins, since
    both sides of each join are fresh shuffles of written tables. Rounds grow as the logarithm of
    the graph's diameter; each is written to the shared folder."""
    a, b = F.col("a"), F.col("b")
    edges = materialize(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        mirrored = edges.union(edges.select(b.alias("a"), a.alias("b")))
        least = materialize(mirrored.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = mirrored.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
        large = materialize(large.union(least.where(F.col("m") < a).select("a", F.col("m").alias("b"))).distinct(), "large-star")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        edges = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        heads = edges.select(b.alias("h")).distinct()
        if edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and edges.join(heads, a == F.col("h"), "left_semi").isEmpty():
            return _named(edges)  # stars already: each node hangs on one root, and no root on another
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum((F.xxhash64("b", "a") % 1000003).cast("long"))).first()
        if now == mark:
            return _named(edges)
        mark = now
    raise RuntimeError("components did not converge")


def _named(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
