"""Run-length and flip-flop coding, as gaps and islands over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(by: list[str], t: str):
    return Window.partitionBy(*by).orderBy(t)


def with_runs(df: DataFrame, changes: Column, by: list[str], t: str = "t") -> DataFrame:
    """Adds ``run``: number of the run a row is in; ``changes`` opens one, and so does the first row."""
    opens = F.coalesce(changes, F.lit(True)).cast("int")
    return df.withColumn("_opens", opens).withColumn("run", F.sum("_opens").over(_order(by, t)) - 1).drop("_opens")


def run_lengths(df: DataFrame, value: str, by: list[str], t: str = "t", tol: float = 0.0) -> DataFrame:
    """(by, run, start, value, length): a new run where a value is more than tol from the one before."""
    before = F.lag(value).over(_order(by, t))
    changes = F.abs(F.col(value) - before) > tol
    rows = with_runs(df, changes, by, t)
    return rows.groupBy(*by, "run").agg(F.min(t).alias("start"), F.min_by(value, t).alias("value"), F.count("*").alias("length"))


def flop_mask(df: DataFrame, label: str, by: list[str], t: str = "t") -> DataFrame:
    """Adds ``flop``: true at the second, fourth, ... place of each run of equal labels."""
    rows = with_runs(df, F.col(label) != F.lag(label).over(_order(by, t)), by, t)
    place = F.row_number().over(Window.partitionBy(*by, "run").orderBy(t))
    return rows.withColumn("flop", place % 2 == 0)


def flipflop_code(df: DataFrame, label: str, n: int, by: list[str], t: str = "t") -> DataFrame:
    """Adds ``code``: the label, plus n at flops."""
    return flop_mask(df, label, by, t).withColumn("code", F.col(label) + F.when(F.col("flop"), n).otherwise(0))


def move_stay(df: DataFrame, code: str, n: int, by: list[str], t: str = "t") -> DataFrame:
    """Adds ``move`` (null at the last row) and ``stay``: indices into the transition scores."""
    after = F.lead(code).over(_order(by, t))
    own = F.col(code)
    return df.withColumn("move", F.when(after.isNotNull(), own + F.least(after, F.lit(n)) * 2 * n)).withColumn("stay", own + F.least(own, F.lit(n)) * 2 * n)


def path_to_sequence(df: DataFrame, state: str, alphabet: str, by: list[str], t: str = "t", with_first: bool = True) -> DataFrame:
    """(by, seq): the bases entered along a path of flip-flop states."""
    before = F.lag(state).over(_order(by, t))
    entered = df.withColumn("_before", before).where((F.col("_before") != F.col(state)) | (F.col("_before").isNull() & F.lit(with_first)))
    letter = F.substring(F.lit(alphabet), (F.col(state) % len(alphabet)).cast("int") + 1, F.lit(1))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), letter.alias("b"))))
    return entered.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "").alias("seq"))


def modified_scores(df: DataFrame, state: str, scores: str, n: int, mods: list[int], by: list[str], t: str = "t") -> DataFrame:
    """Rows where a base is entered, with ``base`` and ``mod_scores``: the scores of its
    modifications, an array slice at the base's offset (canonical entry first)."""
    entered = df.withColumn("_before", F.lag(state).over(_order(by, t))).where(F.col("_before") != F.col(state))
    starts = [sum(1 + m for m in mods[:b]) for b in range(n)]
    base = (F.col(state) % n).cast("int")
    lo = F.element_at(F.array(*map(F.lit, starts)), base + 1)
    size = F.element_at(F.array(*map(F.lit, mods)), base + 1)
    return entered.withColumn("base", base).withColumn("mod_scores", F.slice(F.col(scores), lo + 2, size)).drop("_before")
