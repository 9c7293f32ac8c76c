"""Robust aggregates: median, MAD, log-sum-exp; scaling of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from porelake.operators import scans
from porelake.storage import materialize

# Fixed value: MAD of a normal distribution is its standard deviation / 1.4826.
MAD_FACTOR = 1.4826


def med_mad(df: DataFrame, value: str, by: list[str], factor: float = MAD_FACTOR) -> DataFrame:
    """(by, med, mad) in two aggregations; only medians are joined back. Without ``by`` one row, by
    selection over a written column."""
    if not by:
        rows = materialize(df.select(F.col(value).cast("double").alias("v")), "med-mad")
        (med,) = exact_quantiles(rows, F.col("v"), [0.5])
        (off,) = exact_quantiles(rows, F.abs(F.col("v") - F.lit(med)), [0.5])
        return df.sparkSession.range(1).select(F.lit(med).cast("double").alias("med"), F.lit(None if off is None else factor * off).cast("double").alias("mad"))
    med = F.median(value).over(Window.partitionBy(*by))
    off = df.select(*by, F.col(value), med.alias("med"))
    return off.groupBy(*by).agg(F.first("med").alias("med"), (factor * F.median(F.abs(F.col(value) - F.col("med")))).alias("mad"))


def _sortable(v: Column) -> Column:
    """The bits of a double as a long whose unsigned order is the order of the doubles; -0 is 0."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), v).cast("long")
    return F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(2**63))))


def _numbers(value: Column) -> Column:
    """The value as a double; null for NaN, and 0 for -0."""
    v = value.cast("double")
    return F.when(~F.isnan(v), F.when(v == 0, F.lit(0.0)).otherwise(v))


def _between(lo: Column, hi: Column, share: Column) -> Column:
    """Linear between neighbours; an infinity only counts where its share does."""
    return F.when((lo == hi) | (share == 0), lo).when(share == 1, hi).otherwise(lo + share * (hi - lo))


def exact_quantiles(df: DataFrame, value: Column, qs: list[float], bins: int = 65_536, most: int = 65_536) -> list[float | None]:
    """Exact quantiles of a whole table (linear between neighbours; None of no values, NaN is none).

    Radix selection: values are counted by the leading bits of their sortable key, ``bins`` counts, then
    those that share a rank's bits by the next ones, until a part holds one value or at most ``most``
    rows, which are counted by value. That is at most four passes; the driver gathers at most ``bins``
    counts a rank. An infinity is a value like others."""
    rows = df.select(_numbers(value).alias("v")).where("v IS NOT NULL").select("v", _sortable(F.col("v")).alias("u"))
    digit, found, n = max(1, bins.bit_length() - 1), {}, None
    # (leading bits, rows before, rows, ranks) of the parts that are still open
    parts, shift = [(0, 0, most + 1, [])], 64
    while parts:
        lead = F.lit(0).cast("long") if shift == 64 else F.shiftrightunsigned("u", shift)
        part = rows if shift == 64 else rows.where(lead.isin([p[0] for p in parts]))
        shift = max(0, shift - digit)
        by_value = [F.col("v")] if max(p[2] for p in parts) <= most else []
        counts = part.groupBy(lead.alias("lead"), F.shiftrightunsigned("u", shift).alias("k"), *by_value).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        if n is None:  # the first pass sees every row
            n = sum(r.m for r in counts)
            if not n:
                return [None] * len(qs)
            places = [q * (n - 1) for q in qs]
            parts = [(0, 0, n, sorted({k for p in places for k in (int(p), min(int(p) + 1, n - 1))}))]
        left = []
        for bits, before, _, ranks in parts:
            for r in sorted((c for c in counts if c.lead == bits), key=lambda c: (c.lo, c.hi)):
                inside = [x for x in ranks if before <= x < before + r.m]
                if inside and r.lo == r.hi:
                    found.update(dict.fromkeys(inside, r.lo))
                elif inside:
                    left.append((r.k, before, r.m, inside))
                before += r.m
        parts = left

    def at(p: float) -> float:
        lo, hi, share = found[int(p)], found[min(int(p) + 1, n - 1)], p - int(p)
        return lo if lo == hi or share == 0 else lo + share * (hi - lo)

    return [at(p) for p in places]


def quantiles(df: DataFrame, value: Column, qs: list[float], by: list[str], most: int = 65_536) -> DataFrame:
    """(by, n, quantiles): of every group, by the selection of ``exact_quantiles`` for all groups and
    ranks at once. A pass counts one written narrow column by group, leading bits and next digit and
    keeps the parts that hold a rank, so nothing but counts is shuffled and no task holds a group."""
    group = F.struct(*[F.col(c) for c in by])
    rows = df.select(group.alias("g"), _numbers(value).alias("v")).where("v IS NOT NULL")
    rows = materialize(rows, "quantile-rows").withColumn("u", _sortable(F.col("v")))
    settled, parts, shift, largest = None, None, 64, None
    while True:
        by_value = ["v"] if largest is not None and largest <= most else []
        lead = F.lit(0).cast("long") if parts is None else F.shiftrightunsigned("u", shift)
        part = rows.withColumn("lead", lead)
        part = part if parts is None else part.join(parts.select("g", "lead"), ["g", "lead"], "left_semi")
        shift = max(0, shift - 16)
        counts = part.groupBy("g", "lead", F.shiftrightunsigned("u", shift).alias("k"), *by_value).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        in_part = Window.partitionBy("g", "lead").orderBy("lo", "hi")  # at most 65,536 counts
        counts = counts.withColumn("cum", F.sum("m").over(in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m"))
        if parts is None:
            places = counts.withColumn("n", F.sum("m").over(Window.partitionBy("g")))
            last = F.col("n") - 1
            ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(q * last).cast("long"), F.least(F.floor(q * last).cast("long") + 1, last)) for q in qs])))
            places = places.withColumns({"ranks": ranks, "before": F.col("cum")})
        else:
            places = counts.join(parts.select("g", "lead", "n", "ranks", F.col("before").alias("b")), ["g", "lead"]).withColumn("before", F.col("b") + F.col("cum"))
        held = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("m")))
        places = places.withColumn("ranks", held).where(F.size("ranks") > 0)
        places = materialize(places.select("g", F.col("k").alias("lead"), "n", "m", "lo", "hi", "before", "ranks"), "quantile-parts")
        done = places.where("lo = hi").select("g", "n", F.explode("ranks").alias("rank"), F.col("lo").alias("v"))
        settled = done if settled is None else settled.union(done)
        parts = places.where("lo < hi")
        largest = parts.agg(F.max("m")).first()[0]
        if largest is None:
            break
    of = settled.groupBy("g", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two a quantile
    last = F.col("n") - 1

    def quantile(q: float) -> Column:
        place = F.lit(q) * last
        low = F.floor(place).cast("long")
        return _between(F.element_at("at", low), F.element_at("at", F.least(low + 1, last)), place - low)

    return of.select(*[F.col("g")[c].alias(c) for c in by], "n", F.array(*map(quantile, qs)).alias("quantiles"))


def melted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value): the columns below each other, for quantiles of several columns in the same passes."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.name", "x.value")


def ranks(df: DataFrame, key: str, size: int = 4096) -> tuple[DataFrame, int]:
    """The rows with ``rank``, their place by an integer key that no two share, and how many there
    are. Ranges of keys are numbered apart, after the rows of the ranges before."""
    numbered = scans.numbered(df.withColumn("_all", F.lit(0)), ["_all"], key, size, "rank")
    return numbered.drop("_all"), df.count()


def logsumexp(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, lse), the maximum taken out first."""
    top = F.max(value).over(Window.partitionBy(*by))
    return df.select(*by, F.col(value), top.alias("top")).groupBy(*by).agg((F.first("top") + F.ln(F.sum(F.exp(F.col(value) - F.col("top"))))).alias("lse"))


def logsumexp_array(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.ln(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def scaling_params(df: DataFrame, value: str = "current", by: str = "read_id") -> DataFrame:
    """(read_id, shift, scale) of untrimmed signals; reads without a usable scale are left out."""
    found = med_mad(df, value, [by]).select(by, F.col("med").alias("shift"), F.col("mad").alias("scale"))
    return found.where(F.col("shift").isNotNull() & (F.col("scale") > 0))


def normalise(df: DataFrame, params: DataFrame, value: str = "current", by: str = "read_id") -> DataFrame:
    """(value - shift) / scale. Reads without parameters drop out."""
    return df.join(params, by).withColumn("z", (F.col(value) - F.col("shift")) / F.col("scale"))


def to_picoamps(dac: Column, offset: Column, range_: Column, digitisation: Column) -> Column:
    return (dac + offset) * range_ / digitisation


def trim(signal: Column, start: Column, end: Column) -> Column:
    """Without ``start`` samples at the front and ``end`` at the back; if nothing were left, no trim
    at all; null for negative amounts."""
    n = F.size(signal)
    return F.when((start < 0) | (end < 0), None).when(start + end >= n, signal).otherwise(F.slice(signal, start + 1, n - start - end))


def studentise(x: Column, by: list[str], eps: float = 1e-4) -> Column:
    w = Window.partitionBy(*by)
    return (x - F.avg(x).over(w)) / F.sqrt(F.var_pop(x).over(w) + eps)
