"""Running totals, places and as-of lookups over long groups, in bins.

A window over a whole group is one task, however long the group. Here rows are binned by an integer
position; each (group, bin) is a window of its own, and what the bins before it add comes from the
bins' totals, which are scanned the same way ``fan`` bins at a time, so no task sees more than a bin
of rows or ``fan`` totals. Columns of the group must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bin(at: Column, width: int) -> Column:
    return F.floor(at / F.lit(width)).cast("long")


def carried(bins: DataFrame, by: list[str], bin: str, value: str, how=F.sum, fan: int = 1024) -> DataFrame:
    """(by, bin, carry): what ``how`` (sum or max) makes of the values of all bins before each one; null
    before the first. One row a (by, bin)."""
    lo, hi = bins.agg(F.min(bin), F.max(bin)).first()
    lo, hi = lo or 0, hi or 0
    from_0 = bins.select(*by, (F.col(bin) - lo).alias(bin), value)
    return _carried(from_0, by, bin, value, how, fan, hi - lo).withColumn(bin, F.col(bin) + lo)


def _carried(bins: DataFrame, by: list[str], bin: str, value: str, how, fan: int, last: int) -> DataFrame:
    before = Window.partitionBy(*by, "_block").orderBy(bin).rowsBetween(Window.unboundedPreceding, -1)
    rows = bins.withColumn("_block", _bin(F.col(bin), fan)).withColumn("carry", how(value).over(before))
    if last < fan:
        return rows.select(*by, bin, "carry")
    blocks = rows.groupBy(*by, "_block").agg(how(value).alias(value)).withColumnRenamed("_block", bin)
    above = _carried(blocks, by, bin, value, how, fan, last // fan).select(*by, F.col(bin).alias("_block"), F.col("carry").alias("_above"))
    both = F.coalesce(F.col("carry") + F.col("_above"), "carry", "_above") if how is F.sum else F.greatest("carry", "_above")
    return rows.join(above, [*by, "_block"], "left").select(*by, bin, both.alias("carry"))


def numbered(df: DataFrame, by: list[str], at: str, width: int, name: str = "place", ties: list[str] | None = None) -> DataFrame:
    """The rows with their place, from 0, in their group by an integer column and, within equal values,
    by ``ties``. Bins are ``width`` values wide: choose it so that few rows of a group share one."""
    binned = df.withColumn("_bin", _bin(F.col(at), width))
    totals = carried(binned.groupBy(*by, "_bin").agg(F.count("*").alias("_n")), by, "_bin", "_n")
    own = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(at, *(ties or []))) - 1
    return binned.withColumn("_own", own).join(totals, [*by, "_bin"]).withColumn(name, (F.coalesce("carry", F.lit(0)) + F.col("_own")).cast("long")).drop("_bin", "_own", "carry")


def as_of(points: DataFrame, bases: DataFrame, by: list[str], at: str, loc: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """The points with the largest ``value`` of their group's bases whose ``loc`` is at most ``at``; null
    if none is. ``at`` and ``loc`` are integers; where values ascend with loc this is an as-of join."""
    p = points.withColumns({"_bin": _bin(F.col(at), width), "_at": F.col(at), "_kind": F.lit(1), "_value": F.lit(None).cast("long")})
    b = bases.select(*by, _bin(F.col(loc), width).alias("_bin"), F.col(loc).alias("_at"), F.lit(0).alias("_kind"), F.col(value).cast("long").alias("_value"))
    bins = p.select(*by, "_bin", "_value").union(b.select(*by, "_bin", "_value")).groupBy(*by, "_bin").agg(F.max("_value").alias("_value"))
    within = Window.partitionBy(*by, "_bin").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = p.unionByName(b, allowMissingColumns=True).withColumn("_own", F.max("_value").over(within)).where("_kind = 1")
    met = both.join(carried(bins, by, "_bin", "_value", F.max), [*by, "_bin"])
    return met.select(*points.columns, F.greatest("_own", "carry").alias(name))
