"""A read's signal with its channel and parameters: trimmed, in picoamps, and standardised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porelake.operators import robust

# What holds for a read without a channel or parameters of its own.
CHANNEL = {"offset": 0.0, "range": 1.0, "digitisation": 1.0, "sampling_rate": 4000.0}
PARAMETERS = {"trim_start": 0, "trim_end": 0, "shift": 0.0, "scale": 1.0}


def signals(reads: DataFrame, channels: DataFrame | None = None, params: DataFrame | None = None, by: str = "read_id") -> DataFrame:
    """(by, start, end, sampling_rate, dacs, current, standardised, error) of reads (by, dacs).

    ``channels`` has (by and CHANNEL's columns), ``params`` (by and PARAMETERS'); values that are missing
    or null are the fixed ones. start and end (exclusive) are the kept part of the whole signal, which
    stays whole if nothing were left of it. A negative trim is an error: the arrays are null then."""
    rows = reads.select(by, F.col("dacs").alias("_all"))
    for table, defaults in ((channels, CHANNEL), (params, PARAMETERS)):
        found = {c: F.lit(None) if table is None or c not in table.columns else F.col(f"_given.{c}") for c in defaults}
        met = rows if table is None else rows.join(table.select(by, F.struct(*[c for c in defaults if c in table.columns]).alias("_given")), by, "left")
        rows = met.select(*rows.columns, *[F.coalesce(c, F.lit(defaults[k])).alias(k) for k, c in found.items()])
    n, start, end = F.size("_all"), F.col("trim_start"), F.col("trim_end")
    whole = start + end >= n
    error = F.when((start < 0) | (end < 0), F.lit("a trim is negative"))
    rows = rows.withColumns({"error": error, "start": F.when(whole, 0).otherwise(start), "end": F.when(whole, n).otherwise(n - end), "dacs": robust.trim(F.col("_all"), start, end)})
    current = F.transform("dacs", lambda d: robust.to_picoamps(d, F.col("offset"), F.col("range"), F.col("digitisation")))
    rows = rows.withColumn("current", current)
    standard = F.transform("current", lambda c: (c - F.col("shift")) / F.col("scale"))
    at = [F.when(F.col("error").isNull(), F.col(c)).cast("int").alias(c) for c in ("start", "end")]
    return rows.select(by, *at, "sampling_rate", "dacs", "current", standard.alias("standardised"), "error")
