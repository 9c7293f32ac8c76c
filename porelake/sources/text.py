"""Readers of text formats: FASTA, FASTQ, SAM, TSV, strand lists, alignment summaries.

All read with Spark's text sources, so files of any size are split and gzip and bzip2 are handled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from porelake.functions import qscore, sequence


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, i, value): lines with their place in the file. Lines are counted per block of a file,
    and the counts of the blocks before are added, so no task sees more than a block."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("id"), "value")
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")  # one row a block
    at = lines.join(blocks.select("file", "block", "first", before.alias("before")), ["file", "block"])
    return at.select("file", (F.col("before") + F.col("id") - F.col("first")).alias("i"), "value")


def read_fasta(spark: SparkSession, path: str, filter_ambiguous: bool = False, flatten_ambiguous: bool = False, alphabet: str = "ACGT") -> DataFrame:
    """(read_id, seq). A record begins at a '>' that begins a line; empty ones drop out; of a repeated
    id the last record of the file wins (by its place among the records of the file)."""
    raw = spark.read.text(path, lineSep="\n>").withColumn("_n", F.monotonically_increasing_id())
    lines = F.split(F.regexp_replace("value", r"^>", ""), r"\r?\n")  # the first record keeps its mark
    rows = raw.select("_n", F.split(F.element_at(lines, 1), r"\s+")[0].alias("read_id"), F.array_join(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "").alias("seq"))
    rows = rows.where((F.col("read_id") != "") & (F.col("seq") != ""))
    if filter_ambiguous:
        rows = rows.where(~sequence.has_ambiguity(F.col("seq"), alphabet))
    elif flatten_ambiguous:
        rows = rows.withColumn("seq", sequence.flatten_ambiguity(F.col("seq"), alphabet))
    return rows.groupBy("read_id").agg(F.max_by("seq", "_n").alias("seq"))


def read_fastq(spark: SparkSession, path: str | list[str], max_reads: int | None = None) -> DataFrame:
    """(read_id, seq, qual, length, mean_q): four lines a record, counted within each file."""
    lines = numbered_lines(spark, path)
    rows = lines.groupBy("file", F.floor(F.col("i") / 4).alias("record")).agg(*[F.max(F.when(F.col("i") % 4 == k, F.col("value"))).alias(c) for k, c in ((0, "head"), (1, "seq"), (3, "qual"))])
    rows = rows.where(F.col("head").startswith("@") & F.col("qual").isNotNull())
    phred = qscore.phred(F.col("qual"))
    mean = -10 * F.log10(F.aggregate(phred, F.lit(0.0), lambda a, q: a + qscore.to_error(q)) / F.size(phred))
    rows = rows.select(F.split(F.substring(F.col("head"), F.lit(2), F.length("head")), r"\s+")[0].alias("read_id"), "seq", "qual", F.length("seq").alias("length"), mean.alias("mean_q"))
    return rows.limit(max_reads) if max_reads is not None else rows


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The eleven fixed fields of each record, and the rest as tags."""
    f = F.split("value", "\t")
    fixed = ("qname", "flag:int", "rname", "pos:int", "mapq:int", "cigar", "rnext", "pnext:int", "tlen:int", "seq", "qual")
    cols = [F.get(f, F.lit(k)).cast(c.partition(":")[2] or "string").alias(c.partition(":")[0]) for k, c in enumerate(fixed)]
    return spark.read.text(path).where(~F.col("value").startswith("@")).where(F.size(f) >= 11).select(*cols, F.array_join(F.slice(f, F.lit(12), F.size(f)), "\t").alias("tags"))


def read_tsv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Tab-separated table with header and inferred types; a missing column is a KeyError."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise KeyError(f"{path} has no column {', '.join(missing)}")
    return df


def read_strand_list(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, sep="\t", header=True)
    keys = [c for c in ("filename", "read_id") if c in df.columns]
    if not keys:
        raise ValueError("a strand list needs a column filename or read_id")
    return df.select(*keys)


def read_alignment_summary(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, accuracy, aligned_length, coverage) of either dialect, told apart by its columns;
    negative accuracies become null."""
    head = spark.read.text(path).first()[0]
    df = spark.read.csv(path, sep="\t" if "\t" in head else " ", header=True, inferSchema=True)
    if "alignment_accuracy" in df.columns:
        acc, length = F.col("alignment_accuracy"), F.col("alignment_strand_end") - F.col("alignment_strand_start")
        return df.select("read_id", F.when(acc >= 0, acc).alias("accuracy"), length.alias("aligned_length"), F.lit(1.0).alias("coverage"))
    acc = F.col("accuracy")
    length = F.col("reference_end") - F.col("reference_start") + F.col("insertion") - F.col("deletion")
    return df.select(F.col("query").alias("read_id"), F.when(acc >= 0, acc).alias("accuracy"), length.alias("aligned_length"), "coverage")


def line_blocks(spark: SparkSession, path: str, size: int, header: bool = True, most: int | None = None) -> DataFrame:
    """(block, n, value): a file's lines in blocks of ``size``."""
    rows = numbered_lines(spark, path).withColumn("n", F.col("i") - (1 if header else 0)).where("n >= 0").withColumn("block", F.floor(F.col("n") / size)).select("block", "n", "value")
    return rows.where(F.col("block") < most) if most is not None else rows
