"""Forward passes of network layers over (read_id, t, x array<double>) rows.

Layers without memory are column expressions or windows. Recurrent ones fold over the array of a
read's steps, also as expressions; weights are literals (small, fixed by the model's shape).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from porelake.operators import blocks
from porelake.operators.paths import let, logsumexp


def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(x: Column, w) -> Column:
    return F.aggregate(F.zip_with(x, _array(w), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def feed_forward(x: Column, weights: np.ndarray, bias: np.ndarray, f: Callable[[Column], Column]) -> Column:
    return F.array(*[f(dot(x, w) + F.lit(float(b))) for w, b in zip(weights, bias)])


def log_softmax(x: Column) -> Column:
    return let(x, lambda c: let(logsumexp(c), lambda z: F.transform(c, lambda v: v - z)))


def residual(x: Column, fx: Column) -> Column:
    return F.zip_with(x, fx, lambda a, b: a + b)


def gated_residual(x: Column, fx: Column, alpha: float) -> Column:
    g = float(1 / (1 + np.exp(-alpha)))
    return F.zip_with(x, fx, lambda a, b: g * b + (1 - g) * a)


def parallel(*outputs: Column) -> Column:
    return F.concat(*outputs)


def product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def soft_choice(outputs: list[Column], logits: list[float]) -> Column:
    w = np.exp(np.array(logits) - max(logits))
    w = w / w.sum()
    out = F.transform(outputs[0], lambda v: v * float(w[0]))
    for o, k in zip(outputs[1:], w[1:]):
        out = F.zip_with(out, F.transform(o, _scaled(float(k))), lambda a, b: a + b)
    return out


def _scaled(k: float) -> Callable[[Column], Column]:
    return lambda v: v * k


def global_norm_flipflop(x: Column, weights: np.ndarray, bias: np.ndarray) -> Column:
    """Transition scores, 5 tanh(Wx + b); they are normalised over paths later."""
    return feed_forward(x, weights, bias, lambda v: 5 * F.tanh(v))


def categorical_mods(x: Column, groups: list[list[int]]) -> Column:
    """Log softmax within each canonical base's group of entries."""
    return F.concat(*[log_softmax(F.array(*[F.element_at(x, i + 1) for i in g])) for g in groups])


def reverse_time(df: DataFrame, by: str = "read_id", t: str = "t") -> DataFrame:
    last = F.max(t).over(Window.partitionBy(by))
    return df.withColumn(t, last - F.col(t))


def down_sample(df: DataFrame, n: int, by: str = "read_id", t: str = "t", x: str = "x") -> DataFrame:
    """n steps become one with n times the features; a rest under n steps drops out."""
    rows = df.groupBy(by, F.floor(F.col(t) / n).alias("_t")).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(x).alias("x")))).alias("_x"))
    return rows.where(F.size("_x") == n).select(by, F.col("_t").alias(t), F.flatten(F.transform("_x", lambda s: s["x"])).alias(x))


def up_sample(df: DataFrame, n: int, by: str = "read_id", t: str = "t", x: str = "x") -> DataFrame:
    """One step becomes n with an n-th of the features each."""
    size = (F.size(x) / n).cast("int")
    return df.select(by, F.col(t).alias("_t"), F.col(x).alias("_x"), size.alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k")).select(by, (F.col("_t") * n + F.col("_k")).alias(t), F.slice("_x", F.col("_k") * F.col("_s") + 1, F.col("_s")).alias(x))


def down_up_sample(df: DataFrame, layer: Callable[[DataFrame], DataFrame], n: int) -> DataFrame:
    """A layer over every n steps as one, its output spread over n steps again."""
    return up_sample(layer(down_sample(df, n)), n)


def bidirectional(df: DataFrame, forward: Callable[[DataFrame], DataFrame], backward: Callable[[DataFrame], DataFrame], by: str = "read_id", t: str = "t", x: str = "x") -> DataFrame:
    """The features of a layer over the steps, and of one over the steps from the last to the first."""
    later = reverse_time(backward(reverse_time(df, by, t)), by, t).withColumnRenamed(x, "_back")
    return forward(df).join(later, [by, t]).select(by, t, parallel(F.col(x), F.col("_back")).alias(x))


def squiggle_rows(df: DataFrame, alphabet: str, by: str = "read_id", t: str = "t", x: str = "x") -> DataFrame:
    """(by, t, i, base, current, sd, dwell): three features a base are its level, the log of its
    spread and the log of the rate at which it is left."""
    at = lambda k: F.element_at(x, (3 * F.col("i") + k + 1).cast("int"))
    rows = df.select(by, t, x, F.explode(F.sequence(F.lit(0), F.floor(F.size(x) / 3).cast("int") - 1)).alias("i"))
    base = F.substring(F.lit(alphabet), (F.col("i") % len(alphabet)).cast("int") + 1, F.lit(1))
    return rows.select(by, t, "i", base.alias("base"), at(0).alias("current"), F.exp(at(1)).alias("sd"), F.exp(-at(2)).alias("dwell"))


def convolution(df: DataFrame, kernel: np.ndarray, bias: np.ndarray, f: Callable[[Column], Column], stride: int = 1, by: str = "read_id", t: str = "t", x: str = "x") -> DataFrame:
    """kernel (out, in, width), zero padded by width // 2 before and (width - 1) // 2 after."""
    w = Window.partitionBy(by).orderBy(t)
    width = kernel.shape[2]
    at = [F.lag(x, width // 2 - k).over(w) if k <= width // 2 else F.lead(x, k - width // 2).over(w) for k in range(width)]
    rows = df.select(by, t, *[c.alias(f"_{k}") for k, c in enumerate(at)])
    out = [f(sum((F.coalesce(dot(F.col(f"_{k}"), kernel[o, :, k]), F.lit(0.0)) for k in range(width)), F.lit(0.0)) + F.lit(float(bias[o]))) for o in range(kernel.shape[0])]
    return rows.where(F.col(t) % stride == 0).select(by, F.floor(F.col(t) / stride).alias(t), F.array(*out).alias(x))


def time_linear(df: DataFrame, weights: np.ndarray, by: str = "read_id", t: str = "t", x: str = "x") -> DataFrame:
    """Linear map over the time axis of reads of equal length: row o is the o-th mix of the steps."""
    rows = df.select(by, F.col(t).alias("_t"), F.posexplode(x).alias("_f", "_v"))
    mixed = rows.groupBy(by, "_f").agg(*[F.sum(F.col("_v") * F.element_at(_array(w), (F.col("_t") + 1).cast("int"))).alias(f"_{o}") for o, w in enumerate(weights)])
    tall = mixed.select(by, "_f", F.posexplode(F.array(*[f"_{o}" for o in range(len(weights))])).alias(t, "_v"))
    return tall.groupBy(by, t).agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "_v"))), lambda s: s["_v"]).alias(x))


def _sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def gru_step(state: Column, g: Column, wh: np.ndarray) -> Column:
    """The state after a step; g: its input through the weights of the reset, update and new gates."""
    n = wh.shape[1]

    def of(u: Column) -> Column:
        reset, update = ([_sigmoid(g[at + k] + u[at + k]) for k in range(n)] for at in (0, n))
        new = [F.tanh(g[2 * n + k] + reset[k] * u[2 * n + k]) for k in range(n)]
        return F.struct(F.array(*[(1 - update[k]) * new[k] + update[k] * state["h"][k] for k in range(n)]).alias("h"), state["c"].alias("c"))

    return let(F.array(*[dot(state["h"], w) for w in wh]), of)


def lstm_step(state: Column, g: Column, wh: np.ndarray) -> Column:
    """The state after a step; g: its input through the weights of the input, forget, cell and output gates."""
    n = wh.shape[1]

    def of(a: Column) -> Column:
        cell = F.array(*[_sigmoid(a[n + k]) * state["c"][k] + _sigmoid(a[k]) * F.tanh(a[2 * n + k]) for k in range(n)])
        return let(cell, lambda c: F.struct(F.array(*[_sigmoid(a[3 * n + k]) * F.tanh(c[k]) for k in range(n)]).alias("h"), c.alias("c")))

    return let(F.zip_with(g, F.array(*[dot(state["h"], w) for w in wh]), lambda x, y: x + y), of)


def recurrent(df: DataFrame, kind: str, size: int, wi: np.ndarray, wh: np.ndarray, b: np.ndarray, reverse: bool = False, part: int = 128) -> DataFrame:
    """(read_id, t, x): hidden states of a 'gru' or 'lstm' over each read. Inputs go through their
    weights row by row; only what depends on the state before is done in the order of the steps. One
    state is kept every ``part`` steps, and the parts are then expanded as rows of their own."""
    through = df.select("read_id", F.struct(F.col("t").cast("long").alias("t"), feed_forward(F.col("x"), wi, b, lambda v: v).alias("g")).alias("s"))
    rows = through.groupBy("read_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    step = {"gru": gru_step, "lstm": lstm_step}[kind]
    after = lambda a, s: step(a, s["g"], wh)
    begin = F.struct(*[F.array(*[F.lit(0.0)] * size).alias(c) for c in "hc"])
    rows = blocks.once(rows, chunks=blocks.chunks_of(F.reverse("s") if reverse else F.col("s"), part))
    starts = blocks.checkpointed(F.col("chunks"), begin, after)
    parts = rows.select("read_id", F.explode(F.arrays_zip(F.col("chunks").alias("s"), F.slice(starts, F.lit(1), F.size("chunks")).alias("begin"))).alias("p")).select("read_id", "p.s", "p.begin")
    states = blocks.expanded(F.col("s"), F.col("begin"), after)
    pairs = F.zip_with("s", F.slice(states, F.lit(2), F.size("s")), lambda s, v: F.struct(s["t"].alias("t"), v["h"].alias("x")))
    return parts.select("read_id", F.explode(pairs).alias("r")).select("read_id", "r.t", "r.x")
