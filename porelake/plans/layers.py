"""Activations and network layers: embeddings as (read, step, features)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from porelake.catalog import query
from porelake.functions import activation
from porelake.operators import layers as L
from porelake.operators import networks as N
from porelake.plans._bind import read, score_rows, signal


def weights(*shape: int) -> np.ndarray:
    """Small fixed weights, so that any engine can repeat them."""
    k = np.arange(int(np.prod(shape)))
    return (((k * 31) % 13 - 6) / 13.0).reshape(shape)


V = "(value - 50) / 25"
SQL_OF = {
    "sqr": "x*x", "linear": "x", "relu": "greatest(x, 0)", "relu_smooth": "c01*c01 - 2*c01 + x + abs(x)",
    "softplus": "greatest(x, 0) + ln(1 + exp(-abs(x)))", "elu": "CASE WHEN x > 0 THEN x ELSE 1.6733::DOUBLE * (exp(x) - 1) END",
    "selu": "1.0507::DOUBLE * CASE WHEN x > 0 THEN x ELSE 1.6733::DOUBLE * (exp(x) - 1) END", "gelu": "x / (1 + exp(-1.702::DOUBLE * x))",
    "exp": "exp(x)", "swish": "x / (1 + exp(-x))", "tanh": "(exp(2*x) - 1) / (exp(2*x) + 1)", "sigmoid": "1 / (1 + exp(-x))",
    "l1ml2": "x / sqrt(1 + x*x/2)", "fair": "x / (1 + abs(x) / 1.3998::DOUBLE)", "retu": "(exp(2*greatest(x, 0)) - 1) / (exp(2*greatest(x, 0)) + 1)",
    "tanh_pm": "greatest(-1, least(1, x))", "sigmoid_pm": "greatest(0, least(1, 0.5::DOUBLE + 0.25::DOUBLE*x))", "bounded_linear": "greatest(-1, least(1, x))",
    "sin": "sin(x)", "cauchy": "x / (1 + pow(x / 2.3849::DOUBLE, 2))", "geman_mcclure": "x / pow(1 + x*x, 2)", "welsh": "x * exp(-pow(x / 2.9846::DOUBLE, 2))",
}


@query("activations", f"WITH v AS (SELECT event_id, {V}::DOUBLE AS x FROM events), w AS (SELECT *, greatest(0, least(1, x)) AS c01 FROM v) SELECT event_id, " + ", ".join(f"round({s}, 6) AS \"{n}\"" for n, s in SQL_OF.items()) + " FROM w")
def activations(spark, sf_dir):
    x = (F.col("value") - 50) / 25
    return read(spark, sf_dir, "events").select("event_id", *[F.round(f(x), 6).alias(n) for n, f in activation.ACTIVATIONS.items()])


# the series with its terms in closed form: x to the power 2n + 1 over gamma(n + 3/2)
ERF = "CASE WHEN x = 0 THEN 0 ELSE sign(x) * least(1.0::DOUBLE, exp(-u * u) * list_sum(list_transform(range(129), lambda n: exp((2 * n + 1) * ln(u) - lgamma(n + 1.5::DOUBLE))))) END"


@query("activation_erf", f"SELECT event_id, round({ERF}, 9) AS erf FROM (SELECT event_id, x, least(abs(x), 6) AS u FROM (SELECT event_id, {V}::DOUBLE AS x FROM events))")
def activation_erf(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(activation.erf((F.col("value") - 50) / 25), 9).alias("erf"))


@query("logaddexp", f"SELECT event_id, round(greatest({V}, event_id % 7) + ln(1 + exp(-abs({V} - event_id % 7))), 6) AS y FROM events")
def logaddexp(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(activation.logaddexp((F.col("value") - 50) / 25, (F.col("event_id") % 7).cast("double")), 6).alias("y"))


@query("state_counts", "SELECT p_partkey, 2 * p_size * (p_size + 1) AS n_states, p_size AS n_bases FROM part")
def state_counts(spark, sf_dir):
    s = activation.state_count(F.col("p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", s.alias("n_states"), activation.base_count(s).alias("n_bases"))


def _x(spark, sf_dir, n: int = 64):
    return score_rows(spark, sf_dir, n).select("read_id", "t", F.col("scores").alias("x"))


def _rounded(df):
    return df.select("read_id", F.col("t").cast("long").alias("t"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(F.element_at("x", 1), 6).alias("first"))


WHOLE = "WITH e AS (SELECT vec_id // 10 AS read_id, vec_id % 10 AS t, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
W = str(weights(4, 64).tolist())


def _sql_rows(x: str, tail: str) -> str:
    return f" SELECT read_id, t, round(list_sum(y), 6) AS total, round(y[1], 6) AS first FROM (SELECT read_id, t, {x} AS y {tail})"


LIN = f"list_transform({W}::DOUBLE[][], lambda w: list_inner_product(w, x) + 0.1::DOUBLE)"


@query("layer_feed_forward", WHOLE + _sql_rows(f"list_transform({LIN}, lambda v: greatest(v, 0))", "FROM e"))
def layer_feed_forward(spark, sf_dir):
    return _rounded(_x(spark, sf_dir).withColumn("x", L.feed_forward(F.col("x"), weights(4, 64), np.full(4, 0.1), activation.relu)))


@query("layer_softmax", WHOLE + f", l AS (SELECT read_id, t, {LIN} AS z FROM e)" + _sql_rows("list_transform(z, lambda v: v - (list_max(z) + ln(list_sum(list_transform(z, lambda u: exp(u - list_max(z)))))))", "FROM l"))
def layer_softmax(spark, sf_dir):
    z = L.feed_forward(F.col("x"), weights(4, 64), np.full(4, 0.1), lambda v: v)
    return _rounded(_x(spark, sf_dir).withColumn("x", z).withColumn("x", L.log_softmax(F.col("x"))))


@query("layer_global_norm", WHOLE + f", l AS (SELECT read_id, t, {LIN} AS z FROM e)" + _sql_rows("list_transform(z, lambda v: 5 * (exp(2 * v) - 1) / (exp(2 * v) + 1))", "FROM l"))
def layer_global_norm(spark, sf_dir):
    return _rounded(_x(spark, sf_dir).withColumn("x", L.global_norm_flipflop(F.col("x"), weights(4, 64), np.full(4, 0.1))))


@query("layer_compositions", WHOLE + ", l AS (SELECT read_id, t, x, list_transform(x, lambda v: sin(v)) AS f FROM e) SELECT read_id, t, round(list_sum(x) + list_sum(f), 6) AS residual, round(0.6224593312018546::DOUBLE * list_sum(f) + 0.3775406687981454::DOUBLE * list_sum(x), 6) AS gated, CAST(len(x) + len(f) AS INTEGER) AS parallel, round(list_inner_product(x, f), 6) AS product, round((list_sum(x) + exp(1) * list_sum(f)) / (1 + exp(1)), 6) AS choice FROM l")
def layer_compositions(spark, sf_dir):
    x, f = F.col("x"), F.transform("x", lambda v: F.sin(v))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), 6)
    return _x(spark, sf_dir).select("read_id", "t", total(L.residual(x, f)).alias("residual"), total(L.gated_residual(x, f, 0.5)).alias("gated"), F.size(L.parallel(x, f)).alias("parallel"), total(L.product(x, f)).alias("product"), total(L.soft_choice([x, f], [0.0, 1.0])).alias("choice"))


@query("layer_categorical_mods", WHOLE + ", g AS (SELECT read_id, t, x[1:2] AS a, x[3:5] AS b, x[6:64] AS c FROM e) SELECT read_id, t, round(a[1] - ln(exp(a[1]) + exp(a[2])), 6) AS can_a, round(b[3] - ln(exp(b[1]) + exp(b[2]) + exp(b[3])), 6) AS mod_b, round(c[59] - ln(list_sum(list_transform(c, lambda v: exp(v)))), 6) AS last_c FROM g")
def layer_categorical_mods(spark, sf_dir):
    y = L.categorical_mods(F.col("x"), [[0, 1], [2, 3, 4], list(range(5, 64))])
    return _x(spark, sf_dir).withColumn("y", y).select("read_id", "t", F.round(F.col("y")[0], 6).alias("can_a"), F.round(F.col("y")[4], 6).alias("mod_b"), F.round(F.col("y")[63], 6).alias("last_c"))


@query("layer_reverse", WHOLE + " SELECT read_id, max(t) OVER (PARTITION BY read_id) - t AS t, round(list_sum(x), 6) AS total, round(x[1], 6) AS first FROM e")
def layer_reverse(spark, sf_dir):
    return _rounded(L.reverse_time(_x(spark, sf_dir)))


@query("layer_down_sample", WHOLE + ", d AS (SELECT read_id, t // 2 AS t, flatten(list(x ORDER BY t)) AS y, count(*) AS n FROM e GROUP BY 1, 2) SELECT read_id, t, round(list_sum(y), 6) AS total, round(y[1], 6) AS first FROM d WHERE n = 2")
def layer_down_sample(spark, sf_dir):
    return _rounded(L.down_sample(_x(spark, sf_dir), 2))


@query("layer_up_sample", WHOLE + " SELECT read_id, t * 2 + k AS t, round(list_sum(x[32 * k + 1 : 32 * k + 32]), 6) AS total, round(x[32 * k + 1], 6) AS first FROM e, range(2) r(k)")
def layer_up_sample(spark, sf_dir):
    return _rounded(L.up_sample(_x(spark, sf_dir), 2))


K3 = weights(2, 64, 3)


def _conv_sql(o: int) -> str:
    return " + ".join(f"coalesce(list_inner_product({K3[o, :, k].tolist()}::DOUBLE[], {n}), 0)" for k, n in enumerate(("p", "x", "q")))


@query("layer_convolution", WHOLE + f", c AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS q FROM e WINDOW w AS (PARTITION BY read_id ORDER BY t)), d AS (SELECT read_id, t // 2 AS t, [{_conv_sql(0)} + 0.05::DOUBLE, {_conv_sql(1)} + 0.05::DOUBLE] AS z FROM c WHERE t % 2 = 0)" + _sql_rows("list_transform(z, lambda v: greatest(v, 0))", "FROM d"))
def layer_convolution(spark, sf_dir):
    return _rounded(L.convolution(_x(spark, sf_dir), K3, np.full(2, 0.05), activation.relu, stride=2))


def _both_sql() -> str:
    """The kernel over the steps as they are, beside the kernel over the reversed ones."""
    back = " + ".join(f"coalesce(list_inner_product({K3[0, :, k].tolist()}::DOUBLE[], {n}), 0)" for k, n in enumerate(("q", "x", "p")))
    return f"[greatest({_conv_sql(0)} + 0.05::DOUBLE, 0), greatest({_conv_sql(1)} + 0.05::DOUBLE, 0), greatest({back} + 0.05::DOUBLE, 0)]"


@query("layer_bidirectional", WHOLE + ", c AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS q FROM e WINDOW w AS (PARTITION BY read_id ORDER BY t))" + _sql_rows(_both_sql(), "FROM c"))
def layer_bidirectional(spark, sf_dir):
    forward = lambda df: L.convolution(df, K3, np.full(2, 0.05), activation.relu)
    backward = lambda df: L.convolution(df, K3[:1], np.full(1, 0.05), activation.relu)
    return _rounded(L.bidirectional(_x(spark, sf_dir), forward, backward))


@query("layer_down_up_sample", WHOLE + f", d AS (SELECT read_id, t // 2 AS t, flatten(list(x ORDER BY t)) AS y FROM e GROUP BY 1, 2 HAVING count(*) = 2), l AS (SELECT read_id, t, list_transform({weights(4, 128).tolist()}::DOUBLE[][], lambda w: greatest(list_inner_product(w, y) + 0.1::DOUBLE, 0)) AS z FROM d) SELECT read_id, t * 2 + k AS t, round(list_sum(z[2 * k + 1 : 2 * k + 2]), 6) AS total, round(z[2 * k + 1], 6) AS first FROM l, range(2) r(k)")
def layer_down_up_sample(spark, sf_dir):
    layer = lambda df: df.withColumn("x", L.feed_forward(F.col("x"), weights(4, 128), np.full(4, 0.1), activation.relu))
    return _rounded(L.down_up_sample(_x(spark, sf_dir), layer, 2))


@query("predicted_squiggle", WHOLE + ", s AS (SELECT read_id, t, unnest(range(21)) AS i, x FROM e) SELECT read_id, t, i, substr('ACGT', CAST(i % 4 AS INTEGER) + 1, 1) AS base, round(x[3 * i + 1], 6) AS current, round(exp(x[3 * i + 2]), 6) AS sd, round(exp(-x[3 * i + 3]), 6) AS dwell FROM s")
def predicted_squiggle(spark, sf_dir):
    """Rows of a predicted squiggle: level, spread and rate of every base, from triples of features."""
    return L.squiggle_rows(_x(spark, sf_dir), "ACGT").select("read_id", "t", "i", "base", *[F.round(c, 6).alias(c) for c in ("current", "sd", "dwell")])


@query("layer_time_linear", WHOLE + f", f AS (SELECT read_id, t AS s, unnest(range(64)) AS f, unnest(x) AS v FROM e), m AS (SELECT read_id, o AS t, f, sum(v * (CAST({weights(3, 10).tolist()} AS DOUBLE[][]))[o + 1][s + 1]) AS y FROM f, range(3) r(o) GROUP BY 1, 2, 3) SELECT read_id, t, round(sum(y), 6) AS total, round(arg_min(y, f), 6) AS first FROM m GROUP BY 1, 2")
def layer_time_linear(spark, sf_dir):
    return _rounded(L.time_linear(_x(spark, sf_dir), weights(3, 10)))


def _states_sql(name: str, kind: str, source: str, wi: np.ndarray, wh: np.ndarray, reverse: bool = False) -> str:
    """CTEs of a recurrent layer over ``source``: ``name`` has its hidden states (read_id, t, x)."""
    n = wh.shape[1]
    sig = lambda v: f"(1 / (1 + exp(-({v}))))"
    tanh = lambda v: f"(1 - 2 / (exp(2 * ({v})) + 1))"
    gate = lambda k: f"g[{k * n} + j] + u[{k * n} + j]"
    each = lambda v: f"list_transform(range(1, {n + 1}), lambda j: {v})"
    if kind == "gru":
        new = tanh(f"g[{2 * n} + j] + {sig(gate(0))} * u[{2 * n} + j]")
        c, h = "c", each(f"(1 - {sig(gate(1))}) * {new} + {sig(gate(1))} * h[j]")
    else:
        c, h = each(f"{sig(gate(1))} * c[j] + {sig(gate(0))} * {tanh(gate(2))}"), each(f"{sig(gate(3))} * {tanh('c[j]')}")
    zeros, begin, on = [0.0] * n, "max(t) + 1" if reverse else "CAST(-1 AS BIGINT)", -1 if reverse else 1
    return f""", {name}_g AS (SELECT read_id, t, list_transform({wi.tolist()}::DOUBLE[][], lambda w: list_inner_product(w, x) + 0.1::DOUBLE) AS g FROM {source}),
  {name}_s AS (SELECT read_id, {begin} AS t, CAST(0 AS BIGINT) AS k, {zeros}::DOUBLE[] AS h, {zeros}::DOUBLE[] AS c FROM {source} GROUP BY read_id
  UNION ALL SELECT read_id, t, k + 1, {h}, c FROM (SELECT read_id, t, k, g, u, h, {c} AS c FROM (
    SELECT s.read_id, r.t, k, g, h, c, list_transform({wh.tolist()}::DOUBLE[][], lambda w: list_inner_product(w, h)) AS u FROM {name}_s s JOIN {name}_g r ON r.read_id = s.read_id AND r.t = s.t + {on}))),
  {name} AS (SELECT read_id, t, h AS x FROM {name}_s WHERE k > 0)"""


RECURSIVE = WHOLE.replace("WITH e", "WITH RECURSIVE e", 1)
ROUNDED = " SELECT read_id, t, round(list_sum(x), 6) AS total, round(x[1], 6) AS first FROM "


@query("layer_gru", RECURSIVE + _states_sql("y", "gru", "e", weights(12, 64), weights(12, 4)) + ROUNDED + "y")
def layer_gru(spark, sf_dir):
    return _rounded(L.recurrent(_x(spark, sf_dir), "gru", 4, weights(12, 64), weights(12, 4), np.full(12, 0.1)))


@query("layer_lstm_reverse", RECURSIVE + _states_sql("y", "lstm", "e", weights(16, 64), weights(16, 4), reverse=True) + ROUNDED + "y")
def layer_lstm_reverse(spark, sf_dir):
    return _rounded(L.recurrent(_x(spark, sf_dir), "lstm", 4, weights(16, 64), weights(16, 4), np.full(16, 0.1), reverse=True))


NETWORK = (
    RECURSIVE
    + f", around AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS q FROM e WINDOW w AS (PARTITION BY read_id ORDER BY t)), d AS (SELECT read_id, t, list_transform([{_conv_sql(0)} + 0.05::DOUBLE, {_conv_sql(1)} + 0.05::DOUBLE], lambda v: v / (1 + exp(-v))) AS x FROM around)"
    + _states_sql("y", "lstm", "d", weights(16, 2), weights(16, 4), reverse=True)
    + _states_sql("z", "lstm", "y", weights(16, 4), weights(16, 4))
    + f", o AS (SELECT read_id, t, list_transform({weights(40, 4).tolist()}::DOUBLE[][], lambda w: 5 * (1 - 2 / (exp(2 * list_inner_product(w, x)) + 1))) AS x FROM z)"
)


@query("network_forward", NETWORK + ROUNDED + "o")
def network_forward(spark, sf_dir):
    """Convolution, two recurrent layers in opposite directions, then transition scores."""
    h = L.convolution(_x(spark, sf_dir), K3, np.full(2, 0.05), activation.ACTIVATIONS["swish"])
    for reverse in (True, False):
        size = 2 if reverse else 4
        h = L.recurrent(h, "lstm", 4, weights(16, size), weights(16, 4), np.full(16, 0.1), reverse)
    return _rounded(h.withColumn("x", L.global_norm_flipflop(F.col("x"), weights(40, 4), np.zeros(40))))


# The four architectures on signals, a feature a sample; two bases, the second one with two modifications.
SIGNAL = "WITH RECURSIVE e AS (SELECT user_id AS read_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, [(value - 50) / 25] AS x FROM events)"
TANH, SWISH = "(1 - 2 / (exp(2 * ({0})) + 1))", "(({0}) / (1 + exp(-({0}))))"


def _networks() -> dict[str, N.Network]:
    small = {"insize": 1, "size": 3, "winlen": 5, "n": 2}
    found = {}
    for name, mods in (("flipflop", None), ("cat_mod_flipflop", [0, 2])):
        found[f"network_gru_{name}"] = N.gru_flipflop(weights, stride=2, mods=mods, **small)
        found[f"network_lstm_{name}"] = N.lstm_flipflop(weights, stride=5, mods=mods, narrow=(2, 2), **small)
    return found


def _network_sql(net: N.Network) -> str:
    out, source = SIGNAL, "e"
    for k, c in enumerate(net.convolutions):
        half = c.kernel.shape[2] // 2
        taps = [[f"CASE WHEN t + {j - half} BETWEEN 0 AND len(xs) - 1 THEN list_inner_product({c.kernel[o, :, j].tolist()}::DOUBLE[], xs[t + {1 + j - half}]) ELSE 0 END" for j in range(c.kernel.shape[2])] for o in range(c.kernel.shape[0])]
        sums = ", ".join(" + ".join(t) + " + 0.05::DOUBLE" for t in taps)
        f = {"tanh": TANH, "swish": SWISH}[c.activation].format("v")
        out += f""", a{k} AS (SELECT read_id, list(x ORDER BY t) AS xs FROM {source} GROUP BY read_id),
  c{k} AS (SELECT read_id, t // {c.stride} AS t, list_transform([{sums}], lambda v: {f}) AS x FROM (SELECT read_id, xs, unnest(range(len(xs))) AS t FROM a{k}) WHERE t % {c.stride} = 0)"""
        source = f"c{k}"
    for k, r in enumerate(net.recurrents):
        out += _states_sql(f"r{k}", r.kind, source, r.inner, r.state, r.reverse)
        source = f"r{k}"
    n = net.transitions
    scores = f"list_transform(y[1:{n}], lambda v: 5 * {TANH.format('v')})"
    at = n + 2
    for m in net.mods or []:
        group = f"[{', '.join(f'y[{k}]' for k in (n + 1, *range(at, at + m)))}]"
        scores = f"list_concat({scores}, list_transform({group}, lambda v: v - ln(list_sum(list_transform({group}, lambda u: exp(u))))))"
        at += m
    out += f", h AS (SELECT read_id, t, list_transform({net.weights.tolist()}::DOUBLE[][], lambda w: list_inner_product(w, x)) AS y FROM {source}), s AS (SELECT read_id, t, {scores} AS x FROM h)"
    return out + " SELECT read_id, t, round(list_sum(x), 6) AS total, round(x[1], 6) AS first, round(x[-1], 6) AS last FROM s"


def _network(net: N.Network):
    def run(spark, sf_dir):
        rows = signal(spark, sf_dir).select("read_id", "t", F.array((F.col("current") - 50) / 25).alias("x"))
        total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
        return net.scores(rows).select("read_id", F.col("t").cast("long").alias("t"), F.round(total, 6).alias("total"), F.round(F.col("x")[0], 6).alias("first"), F.round(F.element_at("x", -1), 6).alias("last"))

    return run


for _name, _net in _networks().items():
    query(_name, _network_sql(_net))(_network(_net))
