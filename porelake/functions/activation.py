"""Activation functions as column expressions: they fuse into whole-stage code."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published constants of these functions.
ELU_ALPHA, SELU_LAMBDA = 1.6733, 1.0507
GELU_SLOPE = 1.702
FAIR_C, CAUCHY_C, WELSH_C = 1.3998, 2.3849, 2.9846


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def relu_smooth(x: Column) -> Column:
    y = clamp(x, 0.0, 1.0)
    return y * y - 2 * y + x + F.abs(x)


def softplus(x: Column) -> Column:
    return relu(x) + F.log1p(F.exp(-F.abs(x)))


def elu(x: Column, alpha: float = 1.0, scale: float = 1.0) -> Column:
    return F.lit(scale) * F.when(x > 0, x).otherwise(F.lit(alpha) * F.expm1(x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logaddexp(x: Column, y: Column) -> Column:
    return F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))


def erf(x: Column, terms: int = 128) -> Column:
    """There is no built-in for it: exp(-u*u) times a series of terms of one sign, which loses no digits;
    from 6 on the result is 1 to the last of them. Null for NaN."""
    u = F.least(F.abs(x), F.lit(6.0))
    term = lambda a, k: F.struct((a["t"] * 2 * a["u"] * a["u"] / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * 2 * a["u"] * a["u"] / (2 * k + 1)).alias("s"), a["u"].alias("u"))
    begin = F.struct(u.alias("t"), u.alias("s"), u.alias("u"))
    size = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), begin, term, lambda a: F.least(F.lit(1.0), a["s"] * F.exp(-a["u"] * a["u"]) * (2 / math.sqrt(math.pi))))
    return F.when(~F.isnan(x), F.signum(x) * size)


ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "sqr": lambda x: x * x,
    "linear": lambda x: x,
    "relu": relu,
    "relu_smooth": relu_smooth,
    "softplus": softplus,
    "elu": lambda x: elu(x, ELU_ALPHA),
    "selu": lambda x: elu(x, ELU_ALPHA, SELU_LAMBDA),
    "gelu": lambda x: x * sigmoid(GELU_SLOPE * x),
    "exp": F.exp,
    "swish": lambda x: x * sigmoid(x),
    "tanh": F.tanh,
    "sigmoid": sigmoid,
    "l1ml2": lambda x: x / F.sqrt(1 + 0.5 * x * x),
    "fair": lambda x: x / (1 + F.abs(x) / FAIR_C),
    "retu": lambda x: F.tanh(relu(x)),
    "tanh_pm": lambda x: clamp(x, -1.0, 1.0),
    "sigmoid_pm": lambda x: clamp(0.5 + 0.25 * x, 0.0, 1.0),
    "bounded_linear": lambda x: clamp(x, -1.0, 1.0),
    "sin": F.sin,
    "cauchy": lambda x: x / (1 + (x / CAUCHY_C) * (x / CAUCHY_C)),
    "geman_mcclure": lambda x: x / ((1 + x * x) * (1 + x * x)),
    "welsh": lambda x: x * F.exp(-(x / WELSH_C) * (x / WELSH_C)),
}


def state_count(bases: Column) -> Column:
    """Transition scores of a flip-flop model with so many bases."""
    return 2 * bases * (bases + 1)


def base_count(states: Column) -> Column:
    """Inverse of state_count; null where the number of scores fits no alphabet."""
    n = F.round(F.sqrt(0.25 + 0.5 * states) - 0.5).cast("int")
    return F.when(2 * n * (n + 1) == states, n)
