"""Mapped-read tables in Parquet: schema, reader, writer, checks; and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from porelake.operators import mapping, scans
from porelake.storage import materialize

MAPPED_READS = (
    "read_id string, shift double, scale double, `range` double, offset double, digitisation double, "
    "dacs array<smallint>, ref_to_signal array<int>, reference array<smallint>, mapping_score double, mapping_method string"
)
VERSION = 8
# Columns that every mapped read must have.
REQUIRED = ("read_id", "shift", "scale", "range", "offset", "digitisation", "dacs", "ref_to_signal", "reference")


def missing_columns(reads: DataFrame, required: tuple[str, ...] = REQUIRED) -> list[str]:
    """Names of required columns that a table lacks."""
    return [c for c in required if c not in reads.columns]


def differing_keys(reads: DataFrame, by: str = "read_id", most: int = 10) -> DataFrame:
    """(keys, n, examples, warning): which columns reads have values in, one row for each set of them,
    the most frequent first; where there are several sets, all of them carry a warning. ``examples``
    are up to ``most`` of the set's reads."""
    others = [c for c in reads.columns if c != by]
    keys = F.filter(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in others]), lambda k: k.isNotNull())
    rows = reads.select(F.array_sort(keys).alias("keys"), F.col(by).cast("string").alias("r"))
    sets = rows.groupBy("keys").agg(F.count("*").alias("n"))
    # the smallest ids: each set's rows are cut down before they meet
    few = rows.withColumn("salt", F.pmod(F.xxhash64("r"), F.lit(64)))
    for group in (["keys", "salt"], ["keys"]):
        few = few.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("r"))).where(F.col("place") <= most).drop("place")
    examples = few.groupBy("keys").agg(F.array_sort(F.collect_list("r")).alias("examples"))
    n_sets = sets.agg(F.count("*").alias("n_sets"))
    found = sets.join(examples, "keys").crossJoin(F.broadcast(n_sets))  # one row
    said = F.when(F.col("n_sets") > 1, F.lit("reads of one table have different keys"))
    return found.select("keys", "n", "examples", said.alias("warning")).orderBy(F.col("n").desc(), "keys")


def require_columns(reads: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """The reads; a KeyError that names the required columns they lack."""
    missing = missing_columns(reads, required)
    if missing:
        raise KeyError(f"mapped reads have no column {', '.join(missing)}")
    return reads


def write_mapped(reads: DataFrame, alphabet: DataFrame, path: str, batch: int = 25_000) -> None:
    """reads/ and the alphabet beside it; files hold at most ``batch`` reads. ``require_columns`` and
    ``differing_keys`` tell beforehand what reads lack."""
    reads.write.option("maxRecordsPerFile", batch).parquet(f"{path}/reads")
    alphabet.withColumn("version", F.lit(VERSION)).coalesce(1).write.parquet(f"{path}/alphabet")


def read_mapped(spark: SparkSession, path: str, read_ids: DataFrame | None = None, skip_bad: bool = False) -> DataFrame:
    """The reads, or those of them that are asked for and there; another version is an error, and so
    are missing or damaged files unless they are to be skipped."""
    versions = [r.version for r in spark.read.parquet(f"{path}/alphabet").select("version").distinct().collect()]
    if versions != [VERSION]:
        raise ValueError(f"mapped reads of version {versions} where {VERSION} is needed")
    bad = str(skip_bad).lower()
    reads = spark.read.option("ignoreMissingFiles", bad).option("ignoreCorruptFiles", bad).parquet(f"{path}/reads")
    return reads if read_ids is None else reads.join(read_ids.select("read_id"), "read_id", "left_semi")


def check_mapped(reads: DataFrame, most: int = 1000) -> DataFrame:
    """(read_id, message) of reads that do not pass; one row without an id if there are no reads."""
    said = mapping.check(F.col("reference"), F.col("ref_to_signal"), F.size("dacs"))
    bad = reads.select("read_id", said.alias("message")).where("message != 'pass'").orderBy("read_id").limit(most)
    empty = reads.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("read_id"), F.lit("No reads in file").alias("message"))
    return bad.withColumn("read_id", F.col("read_id").cast("string")).unionByName(empty)


def last_group(groups: DataFrame, attributes: list[str], by: str = "read_id", group: str = "read_group") -> DataFrame:
    """The attributes of each read from the last of its groups, in the order of their names (as
    strings: a read has one group, or numbered ones of which the last counts)."""
    return groups.groupBy(by).agg(*[F.max_by(a, group).alias(a) for a in attributes], F.max(group).alias(group))


def upgrade(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads that carry their alphabet each (version 7) as reads and one alphabet table."""
    cols = ("alphabet", "collapse_alphabet", "mod_long_names")
    return reads.drop(*cols), reads.orderBy("read_id").select(*cols).limit(1)


def write_fasta(df: DataFrame, path: str, read_id: str = "read_id", seq: str = "seq") -> None:
    df.where(F.length(seq) > 0).select(F.concat(F.lit(">"), read_id, F.lit("\n"), seq)).write.text(path)


def write_fastq(df: DataFrame, path: str, backwards: bool = False) -> None:
    seq, qual = (F.reverse(c) if backwards else F.col(c) for c in ("seq", "qual"))
    df.where(F.length("seq") > 0).select(F.concat(F.lit("@"), "read_id", F.lit("\n"), seq, F.lit("\n+\n"), qual)).write.text(path)


def write_tsv(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.csv(path, sep=sep, header=True)


def listed(df: DataFrame, size: int, name: str = "filename", buckets: int = 256) -> DataFrame:
    """(file, place, name): every name with the list it belongs to; all lists but the last hold ``size``
    names, in order. Names are sorted over ranges, and ranges numbered after those before them."""
    ordered = df.select(name).repartitionByRange(buckets, name)
    # ranges ascend with their partition, so the part of the id that names it orders them
    ordered = materialize(ordered.withColumn("range", F.spark_partition_id().cast("long")), "strand-lists")
    before = scans.carried(ordered.groupBy(F.lit(0).alias("all"), "range").agg(F.count("*").alias("n")), ["all"], "range", "n")
    place = F.coalesce("carry", F.lit(0)) + F.row_number().over(Window.partitionBy("range").orderBy(name)) - 1
    numbered = ordered.join(before.select("range", "carry"), "range").select(place.alias("place"), name)
    return numbered.select(F.floor(F.col("place") / size).cast("long").alias("file"), "place", name)


def write_strand_lists(df: DataFrame, path: str, size: int) -> None:
    """Folders file=0, file=1, ..., each with one list of ``size`` names under a header (the last one may
    be shorter). A list is written by one task."""
    rows = listed(df, size)
    n = max(1, (rows.agg(F.max("file")).first()[0] or 0) + 1)
    rows = rows.repartition(int(min(n, 10_000)), "file").sortWithinPartitions("file", "place")
    rows.select("filename", "file").write.partitionBy("file").csv(path, sep="\t", header=True)


def write_samacc(df: DataFrame, path: str) -> None:
    """Measures of alignments, separated by spaces under a header."""
    write_tsv(df, path, sep=" ")


def write_summary(lines: DataFrame, path: str) -> None:
    """The lines (line, value) of a report, some tens, as one text file."""
    lines.repartition(1).sortWithinPartitions("line").select("value").write.text(path)


def write_path_tables(lines: DataFrame, path: str, by: str = "read_id") -> None:
    """The lines (by, i, value) of path tables, in order over the files."""
    lines.repartitionByRange(by, "i").sortWithinPartitions(by, "i").select("value").write.text(path)


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
