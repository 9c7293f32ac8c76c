"""The four network architectures, as chains of layers over (read_id, t, x) rows.

All begin with convolutions, then have five recurrent layers in turn from the last step and from the
first; their heads give transition scores of flips and flops, or those and log probabilities of the
modifications of each base. Weights come from a function of their shape, or from a dict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porelake.functions.activation import ACTIVATIONS
from porelake.operators import blocks, layers
from porelake.operators import paths as P

Weights = Callable[..., np.ndarray]


@dataclass
class Convolution:
    kernel: np.ndarray
    bias: np.ndarray
    activation: str
    stride: int


@dataclass
class Recurrent:
    kind: str
    reverse: bool
    inner: np.ndarray
    state: np.ndarray
    bias: np.ndarray


@dataclass
class Network:
    """``mods``: how many modifications each base has; None for transitions alone."""

    convolutions: list[Convolution]
    recurrents: list[Recurrent]
    weights: np.ndarray
    bias: np.ndarray
    n: int
    mods: list[int] | None = None

    @property
    def transitions(self) -> int:
        return 2 * self.n * (self.n + 1)

    def hidden(self, df: DataFrame) -> DataFrame:
        """(read_id, t, x): what the head is given, a row for each stride."""
        for c in self.convolutions:
            df = layers.convolution(df, c.kernel, c.bias, ACTIVATIONS[c.activation], c.stride)
        for r in self.recurrents:
            df = layers.recurrent(df, r.kind, r.state.shape[1], r.inner, r.state, r.bias, r.reverse)
        return df

    def scores(self, df: DataFrame) -> DataFrame:
        """(read_id, t, x): 5 tanh(Wh + b) for the transitions; with modifications also their log
        softmax, base by base, each beside the shared score of an unmodified base."""
        x = layers.feed_forward(F.col("x"), self.weights, self.bias, lambda v: v)
        y = self.hidden(df).withColumn("x", x)
        y = blocks.once(y.select("read_id", "t", F.col("x").alias("y")), x=F.transform(F.slice("y", 1, self.transitions), lambda v: 5 * F.tanh(v)))
        if self.mods is None:
            return y.select("read_id", "t", "x")
        return y.select("read_id", "t", F.concat("x", self._modified(F.col("y"))).alias("x"))

    def _modified(self, y: Column) -> Column:
        at, groups = self.transitions + 1, []
        for m in self.mods:
            groups.append(layers.log_softmax(F.array(y[self.transitions], *[y[at + k] for k in range(m)])))
            at += m
        return F.concat(*groups)

    def normalised(self, df: DataFrame) -> DataFrame:
        """``scores`` whose paths' weights sum to 1: transitions less the log partition a step. Reads are
        summed up in blocks of steps, so a long one is spread over tasks."""
        y = self.scores(df)
        z = blocks.Blocks.of(y.select("read_id", "t", F.slice("x", 1, self.transitions).alias("scores")), self.n).log_partition(P.start(self.n))
        share = F.col("log_z") / F.col("n")
        moved = F.transform("x", lambda v, i: F.when(i < self.transitions, v - share).otherwise(v))
        return y.join(z, "read_id").select("read_id", "t", moved.alias("x"))


def _stack(kind: str, size: int, make: Weights) -> list[Recurrent]:
    gates = {"gru": 3, "lstm": 4}[kind] * size
    return [Recurrent(kind, k % 2 == 0, make(gates, size), make(gates, size), np.full(gates, 0.1)) for k in range(5)]


def _head(convolutions: list[Convolution], recurrents: list[Recurrent], size: int, n: int, mods: list[int] | None, make: Weights) -> Network:
    outputs = 2 * n * (n + 1) + (0 if mods is None else 1 + sum(mods))
    return Network(convolutions, recurrents, make(outputs, size), np.zeros(outputs), n, mods)


def gru_flipflop(make: Weights, insize: int = 1, size: int = 256, winlen: int = 19, stride: int = 2, n: int = 4, mods: list[int] | None = None) -> Network:
    """One convolution by tanh, five gated recurrent layers; with ``mods`` the modified-base form."""
    first = Convolution(make(size, insize, winlen), np.full(size, 0.05), "tanh", stride)
    return _head([first], _stack("gru", size, make), size, n, mods, make)


def lstm_flipflop(make: Weights, insize: int = 1, size: int = 256, winlen: int = 19, stride: int = 5, n: int = 4, mods: list[int] | None = None, narrow: tuple[int, int] = (4, 16), first_winlen: int = 5) -> Network:
    """Three convolutions by swish, five long short-term memory layers; with ``mods`` the modified-base form."""
    widths = [insize, *narrow, size]
    convolutions = [Convolution(make(b, a, first_winlen if k < 2 else winlen), np.full(b, 0.05), "swish", 1 if k < 2 else stride) for k, (a, b) in enumerate(zip(widths, widths[1:]))]
    return _head(convolutions, _stack("lstm", size, make), size, n, mods, make)
