"""Quality-score arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_error(p: Column, cap: float | None = None) -> Column:
    """-10 log10 p; at p = 0 the cap (null without one: there is no finite score)."""
    return F.when(p > 0, -10 * F.log10(p)).when(p == 0, F.lit(cap).cast("double"))


def to_error(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def to_char(q: Column, zero: int = 33) -> Column:
    """Phred character; halves go up because q + zero + 0.5 is cut, not rounded."""
    return F.char((q + zero + 0.5).cast("int"))


def phred(qual: Column, zero: int = 33) -> Column:
    """Scores of a quality string."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - zero)


def mean_of_read(q: Column) -> Column:
    """Aggregate: mean in the space of probabilities."""
    return -10 * F.log10(F.avg(to_error(q)))


def empirical(accuracy: Column, cap: float) -> Column:
    return F.when(accuracy >= 1, F.lit(cap)).otherwise(F.least(F.lit(cap), -10 * F.log10(1 - accuracy)))


def transitions_into(base: Column, n: int) -> Column:
    """Indices of the transition scores that lead into a base: its flip row, and its flop entries."""
    flip = F.sequence(2 * n * base, 2 * n * base + 2 * n - 1)
    return F.concat(flip, F.array(2 * n * n + base, 2 * n * n + base + n))


def scaled(q: Column, scale: float, bias: float) -> Column:
    return q * scale + bias
