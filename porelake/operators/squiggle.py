"""Levels that references predict, and the table of a path of samples along them, as rows.

A base's level, log spread and rate come from its own and its neighbours' places on a tetrahedron, by
the weights of one convolution. The neighbours are taken from the reference's string, so no window
over a read is needed and a long reference is spread as its bases are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The corners of the tetrahedron that stand for A, C, G and T.
CORNERS = {"A": (1.0, 0.0, -1 / math.sqrt(2)), "C": (-1.0, 0.0, -1 / math.sqrt(2)), "G": (0.0, 1.0, 1 / math.sqrt(2)), "T": (0.0, -1.0, 1 / math.sqrt(2))}


def matched(reads: DataFrame, references: DataFrame, by: str = "read_id", seq: str = "seq") -> DataFrame:
    """The reads with their reference, and an error for those without one or with an empty one."""
    met = reads.join(references.select(by, seq), by, "left")
    return met.withColumn("error", F.when(F.col(seq).isNull(), F.lit("reference not found")).when(F.col(seq) == "", F.lit("reference is empty")))


def levels(references: DataFrame, kernel: np.ndarray, bias: np.ndarray, by: str = "read_id", seq: str = "seq") -> DataFrame:
    """(by, pos, base, current, logsd, rate) of every base; kernel (3 outputs, 3 coordinates, width) of odd
    width, zero beyond the ends. Other letters than A, C, G and T stand at the origin."""
    width = kernel.shape[2]
    half = width // 2
    at = references.where(F.length(seq) > 0).select(by, seq, F.explode(F.sequence(F.lit(1), F.length(seq))).alias("_p"))
    letters = [F.substring(F.col(seq), F.greatest(F.col("_p") + k - half, F.lit(1)), F.lit(1)) for k in range(width)]
    letters = [F.when(F.col("_p") + k - half >= 1, c).otherwise("") for k, c in enumerate(letters)]
    near = at.select(by, (F.col("_p") - 1).cast("long").alias("pos"), letters[half].alias("base"), *[c.alias(f"_{k}") for k, c in enumerate(letters)])

    def weight(o: int, k: int) -> Column:
        """What the base k places along adds to an output."""
        found = F.lit(0.0)
        for b, corner in CORNERS.items():
            found = F.when(F.col(f"_{k}") == b, F.lit(float(sum(w * c for w, c in zip(kernel[o, :, k], corner))))).otherwise(found)
        return found

    out = [sum((weight(o, k) for k in range(width)), F.lit(float(bias[o]))) for o in range(3)]
    return near.select(by, "pos", "base", *[c.alias(n) for c, n in zip(out, ("current", "logsd", "rate"))])


def path_table(path: DataFrame, found: DataFrame, by: str = "read_id") -> DataFrame:
    """(by, i, signal, pos, base, current, logsd, rate): the samples (by, i, signal, pos) of paths with
    what their position predicts; a sample off the reference has null for that."""
    return path.join(found, [by, "pos"], "left").select(by, "i", "signal", "pos", "base", "current", "logsd", "rate")


def table_lines(table: DataFrame, scores: DataFrame, by: str = "read_id") -> DataFrame:
    """(by, i, value): the lines of a file of path tables: a read's id and score, then its samples."""
    head = scores.select(by, F.lit(-1).cast("long").alias("i"), F.concat(F.lit("#"), F.col(by).cast("string"), F.lit(" "), F.col("score").cast("string")).alias("value"))
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (by, "i", "signal", "pos", "base", "current", "logsd", "rate")]
    return head.unionByName(table.select(by, F.col("i").cast("long").alias("i"), F.concat_ws("\t", *columns).alias("value")))
