"""Helpers that the corpus operators share: table access, scratch tables, worker imports."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from porelake.storage import discard_scratch, materialize, scratch_dir, ship_package  # noqa: F401  operators take them from here

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; columns beyond those an operator asks for are ignored by it."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as part of an expression, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def plain_names(docs: DataFrame, known: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The documents with all other columns renamed, so that no name of theirs can clash or needs
    quoting, and what gives the names back."""
    new = [c if c in known else f"kept{k}" for k, c in enumerate(docs.columns)]
    old = docs.columns
    return docs.toDF(*new), lambda out: out.select(*[F.col(n).alias(c) for n, c in zip(new, old)])


def slices(batch: pa.RecordBatch, rows: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows and bytes of text; a longer text is a part by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right"))))
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Return memory that is free to the system. Python workers are used again by later tasks, and
    idle ones would keep what their largest task needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose tasks give their free memory back when they end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


BITMAP = 32_768  # bits of one of Spark's bitmaps


def bit_table(rows: DataFrame, place: Callable[[int], Column], most_bits: int = 1 << 26) -> bytes:
    """A table of bits with those of the rows set. It has a power of two near 16 times as many bits as
    there are rows, but at most ``most_bits``, which bounds what the driver gathers and tasks are sent
    (8 MB): of more rows than that fewer are told apart, but none is missed. ``place(bits)`` gives a
    row's bit."""
    n, bits = rows.count(), BITMAP
    while bits < min(most_bits, 16 * n):
        bits *= 2
    at = place(bits) + 1  # Spark counts from 1
    found = rows.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("at")).groupBy("k").agg(F.bitmap_construct_agg("at").alias("bitmap")).collect()
    out = bytearray(bits // 8)
    for r in found:
        out[(r.k - 1) * BITMAP // 8 : r.k * BITMAP // 8] = r.bitmap
    return bytes(out)


def is_marked(marked: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which bits of a ``bit_table`` (as bytes of an array) are set."""
    return (marked[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Recent(dict):
    """Computes what is missing. At ``limit`` entries they become the old generation, from which
    those still in use come back one by one; the generation before is forgotten. Strings over
    ``longest`` are computed anew each time, so that the entries are bounded in bytes too."""

    def __init__(self, make, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        if isinstance(key, (str, bytes)) and len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self[key] = self.old[key] if key in self.old else self.make(key)
        return value


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
