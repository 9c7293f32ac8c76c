"""Signal-to-reference mappings held as arrays, one row per read.

``ref_to_signal`` has one entry more than the reference: -1 stands before the mapped part and
signal length + 1 after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from porelake.operators import scans


def _inside(r2s: Column, siglen: Column) -> Column:
    """Indices of the entries that point into the signal."""
    return F.filter(F.sequence(F.lit(0), F.size(r2s) - 1), lambda i: (F.element_at(r2s, i + 1) >= 0) & (F.element_at(r2s, i + 1) <= siglen))


def mapped_reference_region(r2s: Column, siglen: Column) -> Column:
    """struct(first, last): of the indices into the reference; (0, 0) if nothing is mapped."""
    at = _inside(r2s, siglen)
    return F.struct(F.coalesce(F.array_min(at), F.lit(0)).alias("first"), F.coalesce(F.array_max(at), F.lit(0)).alias("last"))


def mapped_signal_region(r2s: Column, siglen: Column) -> Column:
    """struct(first, last): of the signal positions; (0, 0) if nothing is mapped."""
    values = F.filter(r2s, lambda v: (v >= 0) & (v <= siglen))
    return F.struct(F.coalesce(F.get(values, F.lit(0)), F.lit(0)).alias("first"), F.coalesce(F.get(values, F.size(values) - 1), F.lit(0)).alias("last"))


def reference_interval(r2s: Column, start: Column, end: Column) -> Column:
    """struct(first, last): the bases that signal [start, end) covers."""
    return F.struct((F.size(F.filter(r2s, lambda v: v <= start)) - 1).alias("first"), F.size(F.filter(r2s, lambda v: v < end)).alias("last"))


def reference_intervals(intervals: DataFrame, bases: DataFrame, reads: DataFrame, by: str = "read_id", start: str = "start", end: str = "end", width: int = 4096) -> DataFrame:
    """The intervals [start, end) of signals with (first, last, error), from maps held as rows.

    ``bases`` has (by, i, loc), a row for each entry of a map, ``reads`` (by, siglen). first is the base
    whose samples start lies in, last one past the base before end. Where start or end lies outside
    the mapped region, from the first to the last entry that points into the signal, first and last are
    null and error says so; a read without such entries has the region [0, 0]. Bins of positions are
    joined, so a long read is spread over tasks."""
    ends = bases.join(reads.select(by, "siglen"), by).where((F.col("loc") >= 0) & (F.col("loc") <= F.col("siglen"))).groupBy(by).agg(F.min("loc").alias("_lo"), F.max("loc").alias("_hi"))
    asked = intervals.withColumn("_last", F.col(end) - 1)
    asked = scans.as_of(asked, bases, [by], start, "loc", "i", "first", width)
    asked = scans.as_of(asked, bases, [by], "_last", "loc", "i", "last", width).join(ends, by, "left")
    lo, hi = (F.coalesce(c, F.lit(0)) for c in ("_lo", "_hi"))
    error = F.when((F.col(start) < lo) | (F.col(end) < lo), F.lit("before the mapped region")).when((F.col(start) > hi) | (F.col(end) > hi), F.lit("after the mapped region"))
    found = asked.withColumn("error", error)
    ok = F.col("error").isNull()
    return found.select(*intervals.columns, F.when(ok, F.coalesce("first", F.lit(-1))).alias("first"), F.when(ok, F.coalesce(F.col("last") + 1, F.lit(0))).alias("last"), "error")


def region(a: Column, lo: Column, hi: Column) -> Column:
    """Half-open slice."""
    return F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0)))


def dwells(r2s: Column) -> Column:
    """Samples per base."""
    return F.zip_with(F.slice(r2s, F.lit(1), F.size(r2s) - 1), F.slice(r2s, F.lit(2), F.size(r2s) - 1), lambda a, b: b - a)


def max_dwell(r2s: Column) -> Column:
    """Longest dwell between the entries given; 1 for a single base."""
    return F.when(F.size(r2s) > 1, F.array_max(dwells(r2s))).otherwise(F.lit(1))


def check(reference: Column, r2s: Column, siglen: Column) -> Column:
    """'pass', or what is wrong with a read, joined by '; '."""
    falls = F.exists(dwells(r2s), lambda d: d < 0)
    said = F.concat_ws(
        "; ",
        F.when(F.size(reference) + 1 != F.size(r2s), F.lit("reference and map differ in length")),
        F.when(F.exists(r2s, lambda v: v < -1), F.lit("map below -1")),
        F.when(F.exists(r2s, lambda v: v > siglen + 1), F.lit("map beyond the signal")),
        F.when(falls, F.lit("map not monotone")),
    )
    return F.when(said == "", F.lit("pass")).otherwise(said)


def path_to_signal(path: DataFrame, stride: int, by: list[str], state: str = "ref", k: str = "k", start: str = "trim_start", siglen: str = "siglen") -> DataFrame:
    """(by, loc, ref): sample of each entry of a path at one entry per stride; what falls outside
    the signal, and clipped entries (-1), drop out."""
    loc = F.col(k) * stride - 1 + F.col(start)
    loc = F.greatest(loc, F.col(start) if stride == 1 else loc)
    return path.where(F.col(state) >= 0).select(*by, loc.alias("loc"), F.col(state).alias("ref"), siglen).where((F.col("loc") >= 0) & (F.col("loc") < F.col(siglen)))


def invert(mapped: DataFrame, reads: DataFrame, by: str = "read_id") -> DataFrame:
    """(by, r, loc) for r = 0 .. reference length: the first sample mapped at or after each base.

    ``mapped`` has (by, loc, ref), ``reads`` (by, reflen, siglen). Bases before the first mapped one
    get -1, skipped ones share the next sample, the entry after the last one is one past the last
    sample, and later ones are siglen + 1; reads without mapped samples are all -1."""
    ends = mapped.groupBy(by).agg(F.min("ref").alias("f"), F.max("ref").alias("l"), F.max("loc").alias("v"))
    firsts = mapped.groupBy(by, "ref").agg(F.min("loc").alias("loc"))
    rows = reads.select(by, "siglen", F.explode(F.sequence(F.lit(0), F.col("reflen").cast("int"))).alias("r")).join(firsts.withColumnRenamed("ref", "r"), [by, "r"], "left").join(ends, by, "left")
    later = F.min("loc").over(Window.partitionBy(by).orderBy("r").rowsBetween(0, Window.unboundedFollowing))
    value = (
        F.when(F.col("f").isNull() | (F.col("r") < F.col("f")), -1)
        .when(F.col("r") <= F.col("l"), later)
        .when(F.col("r") == F.col("l") + 1, F.col("v") + 1)
        .otherwise(F.col("siglen") + 1)
    )
    return rows.select(by, "r", value.cast("int").alias("loc"))


def align_bases(reads: DataFrame, by: str = "read_id", r2s: str = "ref_to_signal", reference: str = "reference") -> DataFrame:
    """(by, i, code, start, dwell): one row per base."""
    return reads.select(by, F.posexplode(F.arrays_zip(F.col(reference).alias("code"), F.slice(F.col(r2s), F.lit(1), F.size(r2s) - 1).alias("start"), dwells(F.col(r2s)).alias("dwell"))).alias("i", "x")).select(by, "i", "x.code", "x.start", "x.dwell")
