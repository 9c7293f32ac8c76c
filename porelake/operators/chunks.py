"""Chunks of mapped reads: windows, filters, sampling, stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from porelake.operators.mapping import mapped_reference_region, mapped_signal_region, max_dwell, reference_interval, region


def overlapping_windows(length: Column, size: int, overlap: int) -> Column:
    """array of struct(start, end): ends every size - overlap from size on, and at the end itself;
    a read shorter than a chunk is one window."""
    ends = F.when(length > size, F.sequence(F.lit(size), length - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    ends = F.concat(ends, F.array(length.cast("int")))
    return F.transform(ends, lambda e: F.struct(F.greatest(F.lit(0), e - size).alias("start"), e.alias("end")))


def stitch_bounds(chunks: DataFrame, stride: int, by: str = "read_id", path: bool = False) -> DataFrame:
    """Adds ``lo`` and ``hi``: the rows of each chunk's output that stay when the outputs are joined
    at the middle of their overlaps. ``path``: outputs hold one row more than blocks."""
    w = Window.partitionBy(by).orderBy("start", "end")
    last_end, next_start = F.lag("end").over(w), F.lead("start").over(w)
    lo = F.when(last_end.isNull(), F.floor(F.col("start") / stride)).otherwise(F.floor((last_end - F.col("start")) / (2 * stride)))
    hi = F.when(next_start.isNull(), F.floor((F.col("end") - F.col("start")) / stride)).otherwise(F.floor((F.col("end") + next_start - 2 * F.col("start")) / (2 * stride)))
    one = F.lit(1 if path else 0)
    return chunks.withColumn("lo", (lo + F.when(last_end.isNull(), 0).otherwise(one)).cast("long")).withColumn("hi", (hi + one).cast("long"))


def stitch(outputs: DataFrame, stride: int, by: str = "read_id", path: bool = False, out: str = "out") -> DataFrame:
    """(by, t, value): the outputs of a read's overlapping chunks as one. outputs: (by, start, end,
    out array), one row a chunk. Chunks are cut where they lie; only their steps are numbered by read."""
    kept = stitch_bounds(outputs, stride, by, path)
    steps = kept.select(by, "start", "end", F.posexplode(F.slice(out, (F.col("lo") + 1).cast("int"), F.greatest(F.col("hi") - F.col("lo"), F.lit(0)).cast("int"))).alias("k", "value"))
    return steps.select(by, (F.row_number().over(Window.partitionBy(by).orderBy("start", "end", "k")) - 1).cast("long").alias("t"), "value")


def _settled(rows: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns through a generator: array functions over whole reads are then computed once,
    and not repeated wherever a later filter or column refers to them."""
    keep = [c for c in rows.columns if c not in cols]
    return rows.select(*keep, F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("_x")).select(*keep, "_x.*")


def fixed_samples(reads: DataFrame, length: int, start: Column) -> DataFrame:
    """A chunk of ``length`` samples at an offset into the mapped signal, or why there is none."""
    rows = _settled(reads, _m=mapped_signal_region(F.col("ref_to_signal"), F.size("dacs")), _s=start)
    spare, at = F.col("_m.last") - F.col("_m.first") - length, F.col("_s") + F.col("_m.first")
    reason = F.when(F.col("_m.last") == 0, "nullmapping").when((spare <= 0) | (F.col("_s") >= spare), "tooshort")
    rows = _settled(rows, start_sample=at, _r=reference_interval(F.col("ref_to_signal"), at, at + length), _why=reason)
    return _chunk(rows, F.col("_r.first"), F.col("_r.last"), F.lit(length)).drop("_m", "_s", "_r", "_why")


def fixed_bases(reads: DataFrame, bases: int, start: Column) -> DataFrame:
    """A chunk of ``bases`` bases at an offset into the mapped reference."""
    rows = _settled(reads, _m=mapped_reference_region(F.col("ref_to_signal"), F.size("dacs")), _s=start)
    spare, r0 = F.col("_m.last") - F.col("_m.first") - bases, F.col("_s") + F.col("_m.first")
    reason = F.when(F.col("_m.last") == 0, "nullmapping").when((spare <= 0) | (F.col("_s") >= spare), "tooshort")
    at = lambda i: F.get(F.col("ref_to_signal"), i)
    rows = _settled(rows, start_sample=at(r0), _why=reason)
    return _chunk(rows, r0, r0 + bases, at(r0 + bases) - at(r0)).drop("_m", "_s", "_why")


def _chunk(rows: DataFrame, r0: Column, r1: Column, length: Column) -> DataFrame:
    fine = F.col("_why").isNull()
    rows = _settled(rows, r0=F.when(fine, r0), r1=F.when(fine, r1), sig_len=F.when(fine, length), seq_len=F.when(fine, r1 - r0))
    n = F.col("seq_len")
    longest = F.when(n > 0, max_dwell(region(F.col("ref_to_signal"), F.col("r0"), F.col("r1"))))
    return _settled(rows, max_dwell=longest, reject_reason=F.coalesce("_why", F.when(n <= 0, "emptysequence").when(F.col("sig_len") <= 0, "emptysignal")))


def mean_dwell(sig_len: Column, seq_len: Column) -> Column:
    return sig_len / (seq_len + F.lit(1e-8))


def apply_filters(chunks: DataFrame, med: Column, mad: Column, stride: int, f_mean: float = 3.0, f_max: float = 10.0, buffer: float = 1.1) -> DataFrame:
    """reject_reason of the first filter that fails: path buffer, mean dwell, longest dwell; chunks
    that are rejected already stay so, and a filter whose parameter is null is left out."""
    mean = mean_dwell(F.col("sig_len"), F.col("seq_len"))
    reason = (
        F.when(F.col("sig_len") / (F.col("seq_len") * stride) <= buffer, "pathbuffer")
        .when(F.abs(mean - med) > f_mean * mad, "meandwell")
        .when(F.col("max_dwell") > f_max * med, "maxdwell")
    )
    return chunks.withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.col("reject_reason").isNull(), reason)))


def sample_attempts(n_reads: int, wanted: int, min_pass: float, seed: int, spark) -> DataFrame:
    """(attempt, pick): draws with replacement, as many as can be needed; a linear congruence of the
    attempt, so that any engine draws the same."""
    tries = int(wanted / min_pass)
    mixed = F.pmod(F.pmod(F.col("id") * 1103515245 + 12345 + seed, F.lit(2147483648)) * 1103515245 + 12345, F.lit(2147483648))
    return spark.range(tries).select(F.col("id").alias("attempt"), F.pmod(F.floor(mixed / 65536), F.lit(n_reads)).alias("pick"))


def random_batches(spark, batches: int, n_reads: int, shortest: int, longest: int, stride: int, least: int, seed: int) -> DataFrame:
    """(batch, chunk_len, slot, pick): every batch draws a chunk length between the shortest and the
    longest, cut to a multiple of the stride, and as many chunks as make it as large as ``least`` chunks
    of the longest one. Draws are congruences of their numbers, so that any engine draws the same."""

    def drawn(x: Column, salt: int) -> Column:
        mixed = F.pmod(F.pmod(x * 1103515245 + 12345 + salt, F.lit(2147483648)) * 1103515245 + 12345, F.lit(2147483648))
        return F.floor(mixed / 65536)

    length = F.floor((F.pmod(drawn(F.col("id"), seed), F.lit(longest - shortest + 1)) + shortest) / stride) * stride
    rows = spark.range(batches).select(F.col("id").alias("batch"), length.alias("chunk_len"))
    size = F.floor(F.lit(float(least)) * longest / F.col("chunk_len") + 0.5)
    slots = rows.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)))
    return slots.withColumn("pick", F.pmod(drawn(F.col("batch") * 64 + F.col("slot"), seed + 1), F.lit(n_reads)))


def reject_tally(chunks: DataFrame) -> DataFrame:
    """(reason, n, place), the most common first."""
    n = chunks.groupBy(F.coalesce("reject_reason", F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "reason")))  # a few reasons
