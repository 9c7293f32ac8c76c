"""Count-based rolling statistics over rows in order (batch form; see streaming for the other)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def trailing(by: list[str], t: str, n: int):
    return Window.partitionBy(*by).orderBy(t).rowsBetween(-(n - 1), 0)


def rolling_quantile(value: Column, u: float, by: list[str], t: str, window: int = 100, min_data: int = 10, default: float | None = None) -> Column:
    """The (1 - u) quantile of the last ``window`` values, this one included; the default before
    ``min_data`` of them."""
    w = trailing(by, t, window)
    return F.when(F.count(value).over(w) < min_data, F.lit(default).cast("double")).otherwise(F.percentile(value, F.lit(1 - u)).over(w))


def _median(xs: Column) -> Column:
    s, n = F.array_sort(xs), F.size(xs)
    low = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(s, (F.floor(n / 2) + 1).cast("int"))
    return (low + high) / 2


def rolling_mad_threshold(value: Column, n_mad: float, by: list[str], t: str, window: int = 100, default: float | None = None, factor: float = 1.4826) -> Column:
    """median + n_mad * MAD of the last ``window`` values; the default until there are so many. The
    MAD needs the frame's own median, so the frame is collected: keep the window small."""
    w = trailing(by, t, window)
    xs = F.collect_list(value).over(w)
    med = F.percentile(value, F.lit(0.5)).over(w)
    mad = factor * _median(F.transform(xs, lambda v: F.abs(v - med)))
    return F.when(F.count(value).over(w) < window, F.lit(default).cast("double")).otherwise(med + n_mad * mad)


def exponential_smoother(value: Column, alpha: float, by: list[str], t: str, window: int = 100) -> Column:
    """Mean of the last ``window`` values, weighted alpha ** age."""
    xs = F.collect_list(value).over(trailing(by, t, window))
    n = F.size(xs)
    weights = F.transform(F.sequence(F.lit(1), n), lambda i: F.pow(F.lit(alpha), n - i))
    total = F.aggregate(F.zip_with(xs, weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return total / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)


def moving_average(value: Column, by: list[str], t: str, window: int) -> Column:
    return F.avg(value).over(trailing(by, t, window))


def delta(value: Column, by: list[str], t: str) -> Column:
    """Difference to the next value; 0 at the end."""
    return F.coalesce(F.lead(value).over(Window.partitionBy(*by).orderBy(t)) - value, F.lit(0.0))


def neighbours(value: Column, by: list[str], t: str, width: int) -> list[Column]:
    """The ``width`` (odd) values around each row, 0 outside."""
    if width % 2 == 0:
        raise ValueError("an odd width is needed")
    w = Window.partitionBy(*by).orderBy(t)
    half = width // 2
    return [F.coalesce(F.lag(value, half - k).over(w) if k <= half else F.lead(value, k - half).over(w), F.lit(0.0)) for k in range(width)]


def linear_schedule(step: Column, lo: float, hi: float, steps: int) -> Column:
    return F.lit(lo) + F.lit(hi - lo) * F.least(F.lit(1.0), step / F.lit(float(steps)))


def inverse_decay(step: Column, d: float) -> Column:
    return F.lit(d) / (step + F.lit(d))


def cosine_schedule(step: Column, lo: float, hi: float, steps: int) -> Column:
    import math

    return F.lit(lo) + F.lit(0.5 * (hi - lo)) * (1 + F.cos(F.lit(math.pi) * F.least(F.lit(1.0), step / F.lit(float(steps)))))
