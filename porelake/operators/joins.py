"""Id filters, lookups, merges and splits of read tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_reads(reads: DataFrame, strand_list: DataFrame | None) -> DataFrame:
    """Reads named by a strand list: by read_id, by filename, or by pairs of both in the list's
    multiplicity. A list with neither column is an error; without a list all reads."""
    if strand_list is None:
        return reads
    keys = [c for c in ("filename", "read_id") if c in strand_list.columns]
    if not keys:
        raise ValueError("a strand list needs a column filename or read_id")
    if len(keys) == 2:
        return reads.join(strand_list.select(*keys), keys)
    return reads.join(strand_list.select(*keys), keys, "left_semi")


def hold_out(reads: DataFrame, held: DataFrame, key: str = "read_id") -> DataFrame:
    return reads.join(held.select(key), key, "left_anti")


def first_file_wins(files: list[DataFrame], key: str = "read_id", limit: int | None = None, seed: int = 0) -> DataFrame:
    """Union of files in which an id of an earlier file hides it in later ones. With a limit, so many
    of each file's ids that no earlier file gave, in the order of a hash."""
    every = None
    for n, f in enumerate(files):
        part = f.withColumn("file_no", F.lit(n))
        if limit is not None:
            fresh = part if every is None else part.join(every.select(key), key, "left_anti")
            part = fresh.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(limit)
        every = part if every is None else every.unionByName(part)
    if limit is not None:
        return every
    return every.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("file_no"))).where("_n = 1").drop("_n")


def remap_guard(has_ref: Column, ref_len: Column, max_len: int, has_params: Column, readable: Column, called: Column) -> Column:
    """Outcome of a remapping job, checked cheapest first."""
    return (
        F.when(~has_ref, "No reference found")
        .when(ref_len > max_len, "Reference too long")
        .when(~has_params, "No read parameters")
        .when(~readable, "Read error")
        .when(~called, "Network error")
        .otherwise("Success")
    )


def reference_slice(seq: Column, start: Column, end: Column, pad: int) -> Column:
    """Part of a reference, widened by pad and kept inside it."""
    lo, hi = F.greatest(F.lit(0), start - pad), F.least(F.length(seq), end + pad)
    return F.substring(seq, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))


def best_by(df: DataFrame, key: list[str], score: str, tie: str) -> DataFrame:
    """The row with the highest score of each key, the first one at ties; null and NaN scores last."""
    value = F.when(~F.isnan(F.col(score).cast("double")), F.col(score))
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(value.desc_nulls_last(), F.col(tie)))).where("_n = 1").drop("_n")


def split_list(df: DataFrame, order: str, size: int, by: list[str] | None = None) -> DataFrame:
    """Adds ``part``: rows in order, cut into lists of ``size``."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    return df.withColumn("part", F.floor((F.row_number().over(w) - 1) / size))


def convert_codes(codes: Column, table: list[int]) -> Column:
    """Integer codes of another alphabet, by lookup."""
    lookup = F.array(*map(F.lit, table))
    return F.transform(codes, lambda c: F.element_at(lookup, (c + 1).cast("int")))


def coordinate_windows(coordinates: DataFrame, references: DataFrame, down: int, up: int, key: str = "read_id", pos: str = "pos", seq: str = "seq") -> DataFrame:
    """Coordinates with ``fragment``: ``down`` bases before the position and ``up`` from it on. Those
    without a reference, or whose window leaves it, drop out."""
    at = coordinates.join(references.select(key, seq), key).where((F.col(pos) >= down) & (F.col(pos) + up <= F.length(seq)))
    return at.withColumn("fragment", F.substring(F.col(seq), (F.col(pos) - down + 1).cast("int"), F.lit(down + up))).drop(seq)


def position_logodds(fragments: DataFrame, references: DataFrame, down: int, alphabet: str = "ACGT", seq: str = "seq") -> DataFrame:
    """(pos, base, n, logodds): share of each base at each place of the fragments over its share in
    the references."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    counts = references.agg(*[F.sum(F.length(seq) - F.length(F.replace(F.col(seq), F.lit(b), F.lit("")))).alias(b) for b in alphabet])
    background = counts.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("n")) for b in alphabet])).alias("x"), sum((F.col(b) for b in alphabet), F.lit(0)).alias("total")).select("x.base", (F.col("x.n") / F.col("total")).alias("share"))
    at = fragments.select(F.posexplode(letters(F.col("fragment"))).alias("k", "base")).groupBy((F.col("k") - down).alias("pos"), "base").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("pos"))  # one row a base
    return at.withColumn("found", share).join(F.broadcast(background), "base").select("pos", "base", "n", F.ln(F.col("found") / F.col("share")).alias("logodds"))  # one row a base
