"""Dynamic programs over transition scores: embeddings are the score rows of reads of ten steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from porelake.catalog import query
from porelake.functions import qscore
from porelake.operators import aligning, blocks, robust, scans, squiggle
from porelake.operators import paths as P
from porelake.operators.layers import log_softmax
from porelake.plans._bind import S, read, score_rows, sequences, signal


# The recursions in SQL: a row holds the weights of the 8 states of a read after t steps.
def _lse(x: str) -> str:
    return f"(list_max({x}) + ln(list_sum(list_transform({x}, lambda u: exp(u - list_max({x}))))))"


NB = 5  # bases of the transition scores
INTO_FLIP = f"list_transform(range({2 * NB}), lambda k: v[k + 1] + x[{2 * NB} * s + k + 1])"
INTO_FLOP = f"[v[s - {NB - 1}] + x[{2 * NB * NB - NB + 1} + s], v[s + 1] + x[{2 * NB * NB + 1} + s]]"
STEPS = "WITH RECURSIVE e AS (SELECT vec_id // 10 AS read_id, vec_id % 10 AS t, list_transform(embedding[1:60], lambda z: z::DOUBLE) AS x FROM embeddings)"


def _begin(flop: str) -> str:
    return f"[{', '.join(['0'] * NB + [flop] * NB)}]"


def _forward(start: str) -> str:
    step = f"list_transform(range({2 * NB}), lambda s: CASE WHEN s < {NB} THEN {_lse(INTO_FLIP)} ELSE {_lse(INTO_FLOP)} END)"
    return STEPS + f""", f AS (SELECT DISTINCT read_id, CAST(0 AS BIGINT) AS t, {start}::DOUBLE[] AS v FROM e
  UNION ALL SELECT f.read_id, f.t + 1, {step} FROM f JOIN e ON e.read_id = f.read_id AND e.t = f.t),
  z AS (SELECT read_id, max(t) AS n, {_lse('arg_max(v, t)')} AS log_z FROM f GROUP BY read_id)"""


def _best_path(source: str) -> str:
    """CTEs whose last one, vit, has the states of the best path over the scores x of ``source``."""
    return f""", vf AS (SELECT DISTINCT read_id, CAST(0 AS BIGINT) AS t, {_begin('-1e30')}::DOUBLE[] AS v,
    list_transform(range({2 * NB}), lambda s: [s]) AS p FROM {source}
  UNION ALL SELECT vf.read_id, vf.t + 1,
    list_transform(range({2 * NB}), lambda s: CASE WHEN s < {NB} THEN list_max({INTO_FLIP}) ELSE list_max({INTO_FLOP}) END),
    list_transform(range({2 * NB}), lambda s: list_append(CASE WHEN s < {NB} THEN p[list_position({INTO_FLIP}, list_max({INTO_FLIP}))]
      WHEN v[s - {NB - 1}] + x[{2 * NB * NB - NB + 1} + s] >= v[s + 1] + x[{2 * NB * NB + 1} + s] THEN p[s - {NB - 1}] ELSE p[s + 1] END, s))
  FROM vf JOIN {source} AS o ON o.read_id = vf.read_id AND o.t = vf.t),
  vb AS (SELECT read_id, arg_max(p, t) AS p, arg_max(v, t) AS v FROM vf GROUP BY read_id),
  vit AS (SELECT read_id, CAST(i AS BIGINT) AS t, CAST(p[list_position(v, list_max(v))][i + 1] AS BIGINT) AS state FROM (SELECT *, unnest(range(len(p[1]))) AS i FROM vb))"""


VITERBI = STEPS + _best_path("e") + " SELECT read_id, t, state FROM vit"


def _steps(spark, sf_dir):
    return P.steps_of(score_rows(spark, sf_dir))


def _once(df, **cols):
    """Columns that later ones refer to, computed once: a generator is not folded into them."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("_x")).select(*df.columns, "_x.*")


@query("viterbi_decode", VITERBI)
def viterbi_decode(spark, sf_dir):
    path = P.viterbi(F.col("steps"), NB)
    return _steps(spark, sf_dir).select("read_id", F.posexplode(path).alias("t", "state")).select("read_id", F.col("t").cast("long").alias("t"), F.col("state").cast("long").alias("state"))


@query("log_partition", _forward(_begin("-50000")) + " SELECT read_id, round(log_z, 6) AS log_z, round(log_z / n, 6) AS per_step FROM z")
def log_partition(spark, sf_dir):
    z = _once(_steps(spark, sf_dir), z=P.log_partition(F.col("steps"), NB, P.start(NB)))
    return z.select("read_id", F.round("z", 6).alias("log_z"), F.round(F.col("z") / F.size("steps"), 6).alias("per_step"))


@query("global_normalise", _forward(_begin("-50000")) + ", g AS (SELECT e.read_id, e.t, list_transform(x, lambda s: s - log_z / n) AS y FROM e JOIN z USING (read_id)) SELECT read_id, t, round(list_sum(y), 6) AS total, round(y[1], 6) AS first, round(y[60], 6) AS last FROM g")
def global_normalise(spark, sf_dir):
    """Transition scores less the log partition a step: the weights of all paths then sum to 1."""
    z = _once(_steps(spark, sf_dir), z=P.log_partition(F.col("steps"), NB, P.start(NB)))
    y = z.select("read_id", F.posexplode(P.normalised(F.col("steps"), F.col("z"))).alias("t", "y"))
    return y.select("read_id", F.col("t").cast("long").alias("t"), F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(F.col("y")[0], 6).alias("first"), F.round(F.element_at("y", -1), 6).alias("last"))


@query("forward_backward", _forward(_begin("0")) + " SELECT read_id, unnest(range(n + 1)) AS t, round(log_z, 6) AS total FROM z")
def forward_backward(spark, sf_dir):
    """Forward and backward weights meet in the same total at every step."""
    both = _once(_steps(spark, sf_dir), f=P.forward(F.col("steps"), NB, P.start(NB, 0.0)), b=P.backward(F.col("steps"), NB))
    total = F.zip_with("f", "b", lambda f, b: P.logsumexp(F.zip_with(f, b, lambda x, y: x + y)))
    return both.select("read_id", F.posexplode(total).alias("t", "total")).select("read_id", F.col("t").cast("long").alias("t"), F.round("total", 6).alias("total"))


def _posteriors(spark, sf_dir):
    """(read_id, steps, post)"""
    rows = _once(_steps(spark, sf_dir), f=P.forward(F.col("steps"), NB, P.start(NB)), b=P.backward(F.col("steps"), NB))
    return _once(rows, post=P.posterior(F.col("steps"), NB, F.col("f"), F.col("b"), P.logsumexp(F.element_at("f", -1)))).drop("f", "b")


# forward and backward vectors of the same recursion, and the probabilities they give
POSTERIOR = (
    _forward(_begin("-50000"))
    + f""", g AS (SELECT read_id, max(t) AS t, list_transform(range({2 * NB}), lambda s: 0.0::DOUBLE) AS v FROM f GROUP BY read_id
  UNION ALL SELECT g.read_id, g.t - 1, list_transform(range({2 * NB}), lambda s: {_lse(f"list_append(list_transform(range({NB}), lambda b: x[{2 * NB} * b + s + 1] + v[b + 1]), x[{2 * NB * NB} + s + 1] + v[{NB} + s % {NB} + 1])")})
  FROM g JOIN e ON e.read_id = g.read_id AND e.t = g.t - 1),
  p AS (SELECT e.read_id, e.t, list_transform(range({2 * NB * (NB + 1)}), lambda i: exp(f.v[i % {2 * NB} + 1] + x[i + 1] + g.v[CASE WHEN i < {2 * NB * NB} THEN i // {2 * NB} ELSE {NB} + i % {NB} END + 1] - log_z)) AS p
    FROM e JOIN f ON f.read_id = e.read_id AND f.t = e.t JOIN g ON g.read_id = e.read_id AND g.t = e.t + 1 JOIN z ON z.read_id = e.read_id)"""
)


@query("posterior_trans", POSTERIOR + " SELECT read_id, t, list_position(p, list_max(p)) - 1 AS best, round(list_max(p), 6) AS p, round(list_sum(p), 6) AS total FROM p")
def posterior_trans(spark, sf_dir):
    """Most probable transition of each step, its probability and the sum over all (1)."""
    p = _posteriors(spark, sf_dir).select("read_id", F.posexplode("post").alias("t", "p"))
    return p.select("read_id", F.col("t").cast("long").alias("t"), (F.array_position("p", F.array_max("p")) - 1).cast("long").alias("best"), F.round(F.array_max("p"), 6).alias("p"), F.round(F.aggregate("p", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("errprobs_from_trans", POSTERIOR.replace("WITH RECURSIVE", "WITH RECURSIVE vit AS (" + VITERBI.replace("WITH RECURSIVE e", "WITH RECURSIVE e") + "),", 1) + f""", c AS (SELECT p.read_id, p.t + 1 AS t, p, state % {NB} AS b FROM p JOIN vit ON vit.read_id = p.read_id AND vit.t = p.t + 1)
  SELECT read_id, t, round(1 - (list_sum(p[{2 * NB} * b + 1 : {2 * NB} * b + {2 * NB}]) + p[{2 * NB * NB} + b + 1] + p[{2 * NB * NB + NB} + b + 1]) / (list_sum(p) + 1e-10), 6) AS perr FROM c""")
def errprobs_from_trans(spark, sf_dir):
    rows = _once(_posteriors(spark, sf_dir), path=P.viterbi(F.col("steps"), NB))
    e = rows.select("read_id", F.posexplode(P.error_probs(F.col("post"), NB, F.col("path"))).alias("t", "perr"))
    return e.select("read_id", (F.col("t") + 1).cast("long").alias("t"), F.round("perr", 6).alias("perr"))


# the sequence every read is compared with: about one base in two steps, squares of their places
CODES = [0, 1, 4, 4 + NB, 1]  # of two equal neighbours the second is a flop
STAY = [c + min(c, NB) * 2 * NB + 1 for c in CODES]
MOVE = [0] + [c + min(d, NB) * 2 * NB + 1 for c, d in zip(CODES, CODES[1:])]
MODIFIED = [c % NB % 4 + 61 for c in CODES]  # the last four of 64 components; the fifth base shares the first


def _spelled(extra: str = "") -> str:
    """Weights of the paths that spell the codes up to each one; a read of n steps has the first n // 2 codes."""
    return f""", q AS (SELECT DISTINCT read_id, CAST(0 AS BIGINT) AS t, {[0.0] + [-1e30] * (len(CODES) - 1)}::DOUBLE[] AS v FROM e
  UNION ALL SELECT q.read_id, q.t + 1, list_transform(range({len(CODES)}), lambda i: {_lse(f"[v[i + 1] + x[({STAY})[i + 1]], CASE WHEN i = 0 THEN -1e30 ELSE v[i] + x[({MOVE})[i + 1]]{extra} END]")})
  FROM q JOIN e ON e.read_id = q.read_id AND e.t = q.t),
  k AS (SELECT read_id, max(t) AS n, greatest(2, max(t) // 2) AS codes, -arg_max(v, t)[greatest(2, max(t) // 2)] / max(t) AS cost FROM q GROUP BY read_id)"""


def _spelling(spark, sf_dir, n: int = 60):
    """(read_id, steps, codes)"""
    rows = P.steps_of(score_rows(spark, sf_dir, n))
    return _once(rows, codes=F.slice(F.array(*map(F.lit, CODES)), F.lit(1), F.greatest(F.lit(2), F.floor(F.size("steps") / 2).cast("int"))))


REMAP = (
    STEPS
    + f""", n AS (SELECT read_id, count(*) AS n, greatest(2, count(*) // 2) AS codes FROM e GROUP BY read_id),
  r AS (SELECT read_id, CAST(0 AS BIGINT) AS t, codes, list_transform(range(codes + 2), lambda i: CASE WHEN i < 2 THEN 0.0::DOUBLE ELSE -1e30::DOUBLE END) AS u, list_transform(range(codes + 2), lambda i: [i]) AS p FROM n
  UNION ALL SELECT read_id, t + 1, codes, list_transform(range(codes + 2), lambda i: greatest(s[i + 1], c[i + 1])),
    list_transform(range(codes + 2), lambda i: list_append(CASE WHEN s[i + 1] < c[i + 1] THEN p[i] ELSE p[i + 1] END, i))
  FROM (SELECT r.read_id, r.t, codes, p,
      list_transform(range(codes + 2), lambda i: u[i + 1] + CASE WHEN i = 0 THEN greatest(x[({STAY})[1]], -1.0::DOUBLE) WHEN i = codes + 1 THEN 0 ELSE x[({STAY})[i]] END) AS s,
      list_transform(range(codes + 2), lambda i: CASE WHEN i = 0 THEN -1e30::DOUBLE WHEN i = 1 OR i = codes + 1 THEN u[i] - 1.0::DOUBLE ELSE u[i] + x[({MOVE})[i]] END) AS c
    FROM r JOIN e ON e.read_id = r.read_id AND e.t = r.t)),
  z AS (SELECT read_id, codes, arg_max(u, t) AS u, arg_max(p, t) AS p FROM r GROUP BY read_id, codes),
  f AS (SELECT read_id, codes, CASE WHEN u[codes + 2] >= u[codes + 1] THEN codes + 2 ELSE codes + 1 END AS place, u, p FROM z),
  w AS (SELECT read_id, codes, u[place] AS score, unnest(range(len(p[place]))) AS t, unnest(p[place]) AS state FROM f)
  SELECT read_id, t, CAST(CASE WHEN state BETWEEN 1 AND codes THEN state - 1 ELSE -1 END AS BIGINT) AS position, round(score, 6) AS score FROM w"""
)


@query("flipflop_remap", REMAP)
def flipflop_remap(spark, sf_dir):
    path, score = aligning.remap(_spelling(spark, sf_dir), NB, 1.0)
    return path.join(score, "read_id").select("read_id", "t", "position", F.round("score", 6).alias("score"))


@query("crf_cost", _forward(_begin("-50000")) + _spelled() + " SELECT k.read_id, round(cost, 6) AS cost, round(cost + log_z / z.n, 6) AS loss FROM k JOIN z USING (read_id)")
def crf_cost(spark, sf_dir):
    """Training loss of a read: cost of its sequence and log partition, both a step."""
    found = _once(_spelling(spark, sf_dir), cost=P.sequence_cost(F.col("steps"), NB, F.col("codes")), z=P.log_partition(F.col("steps"), NB, P.start(NB)))
    return found.select("read_id", F.round("cost", 6).alias("cost"), F.round(F.col("cost") + F.col("z") / F.size("steps"), 6).alias("loss"))


LAST = len(CODES) - 1
GRADIENT = (
    STEPS
    + _spelled()
    + f""", r AS (SELECT read_id, n AS t, list_transform(range({LAST + 1}), lambda i: CASE WHEN i = codes - 1 THEN 0.0::DOUBLE ELSE -1e30::DOUBLE END) AS v FROM k
  UNION ALL SELECT r.read_id, r.t - 1, list_transform(range({LAST + 1}), lambda i: {_lse(f"[v[i + 1] + x[({STAY})[i + 1]], CASE WHEN i = {LAST} THEN -1e30 ELSE v[i + 2] + x[({MOVE})[i + 2]] END]")})
  FROM r JOIN e ON e.read_id = r.read_id AND e.t = r.t - 1),
  w AS (SELECT q.read_id, q.t, k.n, unnest(range({LAST + 1})) AS i, q.v AS f, r.v AS b, x, -cost * k.n AS log_z
    FROM q JOIN r ON r.read_id = q.read_id AND r.t = q.t + 1 JOIN e ON e.read_id = q.read_id AND e.t = q.t JOIN k ON k.read_id = q.read_id),
  o AS (SELECT read_id, t, n, ({STAY})[i + 1] AS place, exp(f[i + 1] + x[({STAY})[i + 1]] + b[i + 1] - log_z) AS p FROM w
    UNION ALL SELECT read_id, t, n, ({MOVE})[i + 2], exp(f[i + 1] + x[({MOVE})[i + 2]] + b[i + 2] - log_z) FROM w WHERE i < {LAST}),
  g AS (SELECT read_id, t, n, place, sum(p) AS p FROM o GROUP BY read_id, t, n, place)
  SELECT read_id, t, round(-sum(p) / n, 6) AS total, CAST(arg_max(place, p) - 1 AS BIGINT) AS steepest FROM g GROUP BY read_id, t, n"""
)


@query("crf_gradient", GRADIENT)
def crf_gradient(spark, sf_dir):
    """Of each step the sum of the gradient, and the score along which the cost falls most."""
    ahead, back = P.spelled(F.col("steps"), NB, F.col("codes"))
    rows = _once(_spelling(spark, sf_dir), f=ahead, b=back)
    g = rows.select("read_id", F.posexplode(P.sequence_gradient(F.col("steps"), NB, F.col("codes"), F.col("f"), F.col("b"))).alias("t", "g"))
    return g.select("read_id", F.col("t").cast("long").alias("t"), F.round(F.aggregate("g", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), (F.array_position("g", F.array_min("g")) - 1).cast("long").alias("steepest"))


@query("catmod_cost", STEPS.replace("embedding[1:60]", "embedding") + _spelled(f" + 0.5::DOUBLE * x[({MODIFIED})[i + 1]]") + " SELECT read_id, round(cost, 6) AS cost FROM k")
def catmod_cost(spark, sf_dir):
    """The last four components stand for modifications of the bases; the fifth shares the first."""
    entered, half = F.transform("codes", lambda c: (c % NB % 4 + 61).cast("int")), F.transform("codes", lambda c: F.lit(0.5))
    cost = P.sequence_cost(F.col("steps"), NB, F.col("codes"), entered=entered, weights=half)
    return _spelling(spark, sf_dir, 64).select("read_id", F.round(cost, 6).alias("cost"))


HALF = f" + 0.5::DOUBLE * x[({MODIFIED})[i + 1]]"
CATMOD_GRADIENT = (
    STEPS.replace("embedding[1:60]", "embedding")
    + _spelled(HALF)
    + f""", r AS (SELECT read_id, n AS t, list_transform(range({LAST + 1}), lambda i: CASE WHEN i = codes - 1 THEN 0.0::DOUBLE ELSE -1e30::DOUBLE END) AS v FROM k
  UNION ALL SELECT r.read_id, r.t - 1, list_transform(range({LAST + 1}), lambda i: {_lse(f"[v[i + 1] + x[({STAY})[i + 1]], CASE WHEN i = {LAST} THEN -1e30 ELSE v[i + 2] + x[({MOVE})[i + 2]] + 0.5::DOUBLE * x[({MODIFIED})[i + 2]] END]")})
  FROM r JOIN e ON e.read_id = r.read_id AND e.t = r.t - 1),
  w AS (SELECT q.read_id, q.t, k.n, unnest(range({LAST + 1})) AS i, q.v AS f, r.v AS b, x, -cost * k.n AS log_z
    FROM q JOIN r ON r.read_id = q.read_id AND r.t = q.t + 1 JOIN e ON e.read_id = q.read_id AND e.t = q.t JOIN k ON k.read_id = q.read_id),
  mv AS (SELECT *, exp(f[i + 1] + x[({MOVE})[i + 2]] + 0.5::DOUBLE * x[({MODIFIED})[i + 2]] + b[i + 2] - log_z) AS p FROM w WHERE i < {LAST}),
  o AS (SELECT read_id, t, n, ({STAY})[i + 1] AS place, exp(f[i + 1] + x[({STAY})[i + 1]] + b[i + 1] - log_z) AS p FROM w
    UNION ALL SELECT read_id, t, n, ({MOVE})[i + 2], p FROM mv UNION ALL SELECT read_id, t, n, ({MODIFIED})[i + 2], 0.5::DOUBLE * p FROM mv),
  g AS (SELECT read_id, t, n, place, sum(p) AS p FROM o GROUP BY read_id, t, n, place)
  SELECT read_id, t, round(-coalesce(sum(p) FILTER (place <= 60), 0) / n, 6) + 0 AS transitions, round(-coalesce(sum(p) FILTER (place > 60), 0) / n, 6) + 0 AS modifications FROM g GROUP BY read_id, t, n"""
)


@query("catmod_gradient", CATMOD_GRADIENT)
def catmod_gradient(spark, sf_dir):
    """Of each step the sum of the gradient over the transitions, and over the modifications' scores."""
    entered, half = (lambda codes: F.transform(codes, lambda c: (c % NB % 4 + 61).cast("int"))), (lambda codes: F.transform(codes, lambda c: F.lit(0.5)))
    g = blocks.gradient_rows(_spelling(spark, sf_dir, 64), NB, entered=entered, weights=half)
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda x, v: x + v), 6) + 0.0
    return g.select("read_id", "t", total(F.slice("g", 1, 60)).alias("transitions"), total(F.slice("g", 61, 4)).alias("modifications"))


# Three long reads hold all vectors in turn; blocks of steps are worked on beside each other.
LONG = "WITH RECURSIVE e AS (SELECT vec_id % 3 AS read_id, row_number() OVER (PARTITION BY vec_id % 3 ORDER BY vec_id) - 1 AS t, list_transform(embedding[1:60], lambda z: z::DOUBLE) AS x FROM embeddings)"


def _long(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).alias("read_id"), "vec_id", F.transform(F.slice("embedding", 1, 60), lambda v: v.cast("double")).alias("scores"))
    return scans.numbered(rows, ["read_id"], "vec_id", 4096, "t").select("read_id", "t", "scores")


@query("viterbi_long", VITERBI.replace(STEPS, LONG))
def viterbi_long(spark, sf_dir):
    return blocks.viterbi(_long(spark, sf_dir), NB).withColumn("state", F.col("state").cast("long"))


@query("forward_backward_long", (_forward(_begin("0")) + " SELECT read_id, unnest(range(n + 1)) AS t, round(log_z, 6) AS total FROM z").replace(STEPS, LONG))
def forward_backward_long(spark, sf_dir):
    b = blocks.Blocks.of(_long(spark, sf_dir), NB)
    met = b.forward(P.start(NB, 0.0)).join(b.backward().withColumnRenamed("v", "w"), ["read_id", "t"])
    return met.select("read_id", "t", F.round(P.logsumexp(F.zip_with("v", "w", lambda x, y: x + y)), 6).alias("total"))


@query("posterior_long", (POSTERIOR + " SELECT read_id, t, list_position(p, list_max(p)) - 1 AS best, round(list_max(p), 6) AS p, round(list_sum(p), 6) AS total FROM p").replace(STEPS, LONG))
def posterior_long(spark, sf_dir):
    p = blocks.Blocks.of(_long(spark, sf_dir), NB).posteriors(P.start(NB))
    return p.select("read_id", "t", (F.array_position("p", F.array_max("p")) - 1).cast("long").alias("best"), F.round(F.array_max("p"), 6).alias("p"), F.round(F.aggregate("p", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("global_normalise_long", (_forward(_begin("-50000")) + " SELECT e.read_id, t, round(list_sum(x) - 60 * log_z / n, 6) AS total FROM e JOIN z USING (read_id)").replace(STEPS, LONG))
def global_normalise_long(spark, sf_dir):
    rows = _long(spark, sf_dir)
    z = blocks.Blocks.of(rows, NB).log_partition(P.start(NB))
    total = F.aggregate("scores", F.lit(0.0), lambda a, v: a + v)
    return rows.join(z, "read_id").select("read_id", "t", F.round(total - 60 * F.col("log_z") / F.col("n"), 6).alias("total"))


BLANK = 63
CTC = f"""WITH RECURSIVE e AS (SELECT vec_id // 10 AS read_id, vec_id % 10 AS t, list_transform(embedding, lambda z: z::DOUBLE) AS x FROM embeddings),
  l AS (SELECT read_id, t, list_transform(x, lambda z: z - {_lse('x')}) AS x FROM e),
  b AS (SELECT read_id, count(*) AS n, list_append(flatten(list_transform(range(greatest(1, count(*) // 3)), lambda k: [{BLANK}, k % {BLANK}])), {BLANK}) AS states FROM e GROUP BY read_id),
  f AS (SELECT read_id, CAST(0 AS BIGINT) AS t, n, states, list_transform(range(len(states)), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE -1e30::DOUBLE END) AS v FROM b
  UNION ALL SELECT f.read_id, f.t + 1, n, states, list_transform(range(len(states)), lambda i: x[states[i + 1] + 1] + {_lse(f"[v[i + 1], CASE WHEN i > 0 THEN v[i] ELSE -1e30::DOUBLE END, CASE WHEN i > 1 AND states[i + 1] <> {BLANK} AND states[i + 1] <> states[i - 1] THEN v[i - 1] ELSE -1e30::DOUBLE END]")})
  FROM f JOIN l ON l.read_id = f.read_id AND l.t = f.t)
  SELECT read_id, round(-{_lse('v[len(states) - 1 : len(states)]')} / n, 6) AS cost FROM f WHERE t = n"""


@query("ctc_cost", CTC)
def ctc_cost(spark, sf_dir):
    """A label for every three steps, spelled by the softmax of all components."""
    rows = P.steps_of(score_rows(spark, sf_dir, 64)).withColumn("steps", F.transform("steps", log_softmax))
    labels = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.floor(F.size("steps") / 3).cast("int")) - 1), lambda k: k % BLANK)
    rows = _once(rows, states=P.ctc_states(labels, BLANK))
    return rows.select("read_id", F.round(P.ctc_cost(F.col("steps"), F.col("states"), BLANK), 6).alias("cost"))


# sequences of states with their weights, five kept a step; g: the weights of all paths on
BEAMS = (
    STEPS
    + f""", n AS (SELECT read_id, max(t) + 1 AS n FROM e GROUP BY read_id), g AS (SELECT read_id, n AS t, list_transform(range({2 * NB}), lambda s: 0.0::DOUBLE) AS v FROM n
  UNION ALL SELECT g.read_id, g.t - 1, list_transform(range({2 * NB}), lambda s: {_lse(f"list_append(list_transform(range({NB}), lambda b: x[{2 * NB} * b + s + 1] + v[b + 1]), x[{2 * NB * NB} + s + 1] + v[{NB} + s % {NB} + 1])")})
  FROM g JOIN e ON e.read_id = g.read_id AND e.t = g.t - 1),
  b AS (SELECT read_id, CAST(0 AS BIGINT) AS t, list_transform(range({2 * NB}), lambda s: {{'p': [s], 'w': 0.0::DOUBLE}}) AS beams FROM n
  UNION ALL SELECT read_id, t + 1, list_transform(list_sort(list_transform(list_transform(list_distinct(list_transform(ways, lambda c: c.p)), lambda q: {{'p': q, 'w': {_lse("list_transform(list_filter(ways, lambda c: c.p = q), lambda c: c.w)")}}}),
      lambda c: {{'k': -(c.w + v[c.p[len(c.p)] + 1]), 'p': c.p, 'w': c.w}}))[1:5], lambda c: {{'p': c.p, 'w': c.w}})
  FROM (SELECT b.read_id, b.t, v, flatten(list_transform(beams, lambda c: list_transform(range({NB + 1}), lambda k:
      CASE WHEN k < {NB} THEN {{'p': CASE WHEN k = c.p[len(c.p)] THEN c.p ELSE list_append(c.p, k) END, 'w': c.w + x[{2 * NB} * k + c.p[len(c.p)] + 1]}}
      ELSE {{'p': CASE WHEN c.p[len(c.p)] >= {NB} THEN c.p ELSE list_append(c.p, {NB} + c.p[len(c.p)]) END, 'w': c.w + x[{2 * NB * NB} + c.p[len(c.p)] + 1]}} END))) AS ways
    FROM b JOIN e ON e.read_id = b.read_id AND e.t = b.t JOIN g ON g.read_id = b.read_id AND g.t = b.t + 1)),
  z AS (SELECT read_id, list_sort(list_transform(arg_max(beams, t), lambda c: {{'w': c.w, 'p': c.p}}))[-1] AS best FROM b GROUP BY read_id)
  SELECT read_id, round(best.w, 6) AS score, array_to_string(list_transform(best.p[2:], lambda s: substr('ACGTZ', CAST(s % {NB} AS INTEGER) + 1, 1)), '') AS seq FROM z"""
)


@query("beam_search", BEAMS)
def beam_search(spark, sf_dir):
    found = _once(_steps(spark, sf_dir), b=P.beam_search(F.col("steps"), NB, P.backward(F.col("steps"), NB)))
    letters = F.transform(F.slice(F.col("b.p"), F.lit(2), F.size("b.p")), lambda s: F.element_at(F.array(*map(F.lit, "ACGTZ")), (s % NB + 1).cast("int")))
    return found.select("read_id", F.round("b.w", 6).alias("score"), F.array_join(letters, "").alias("seq"))


def _signals(spark, sf_dir):
    """(read_id, signal, levels): a read of n samples runs over a third as many made-up levels."""
    rows = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    reads = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("read_id")).agg(F.transform(rows, lambda r: r["value"]).alias("signal"))
    n = F.greatest(F.lit(1), F.floor(F.size("signal") / 3).cast("int"))
    level = lambda k: F.struct((20.0 + 15.0 * (k % 5)).alias("location"), F.lit(2.5).alias("logsd"), F.lit(0.0).alias("rate"))
    return blocks.once(reads, levels=F.transform(F.sequence(F.lit(0), n - 1), level))


DENSITY = "(-ln(2::DOUBLE) - 2.5::DOUBLE - abs(value - (20 + 15 * (i % 5))) * exp(-2.5::DOUBLE))"
ON, STILL = "ln((1 - 1e-15::DOUBLE) / 2)", "ln(1 - (1 - 1e-15::DOUBLE) / 2 - 1e-15::DOUBLE)"
SIGNALS = "WITH RECURSIVE e AS (SELECT user_id AS read_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, value FROM events), n AS (SELECT read_id, count(*) AS n, greatest(1, count(*) // 3) AS l FROM e GROUP BY read_id)"


def _lae(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(1 + exp(-abs({a} - ({b})))))"


HALF_ODDS, STEP_BACK = "ln(0.5::DOUBLE)", "ln(1e-15::DOUBLE)"
# v: weights of the ways to a position; w: to it after a step back
CAME = _lae(f"v[i + 1] + {STILL}", f"CASE WHEN i = 0 THEN -1e30::DOUBLE ELSE v[i] + {ON} END")
ENTERED = _lae("c[i + 1]", f"CASE WHEN i = 0 THEN -1e30::DOUBLE ELSE w[i] + {HALF_ODDS} END")
STEPPED = _lae(f"w[i + 1] + {HALF_ODDS}", f"CASE WHEN i = l - 1 THEN -1e30::DOUBLE ELSE v[i + 2] + {STEP_BACK} END")
SQUIGGLE_SUMS = (
    SIGNALS
    + f""", f AS (SELECT read_id, CAST(0 AS BIGINT) AS t, l, list_transform(range(l), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE -1e30::DOUBLE END) AS v, list_transform(range(l), lambda i: -1e30::DOUBLE) AS w FROM n
    UNION ALL SELECT read_id, t + 1, l, list_transform(range(l), lambda i: {ENTERED} + {DENSITY}), list_transform(range(l), lambda i: {STEPPED} + {DENSITY})
    FROM (SELECT f.*, value, list_transform(range(l), lambda i: {CAME}) AS c FROM f JOIN e ON e.read_id = f.read_id AND e.t = f.t))"""
)


@query("squiggle_cost", SQUIGGLE_SUMS + " SELECT read_id, round(-arg_max(v, t)[l], 6) AS cost FROM f GROUP BY read_id, l")
def squiggle_cost(spark, sf_dir):
    cost = aligning.squiggle_cost(F.col("signal"), F.col("levels"))
    return _signals(spark, sf_dir).select("read_id", F.round(cost, 6).alias("cost"))


LEFT_V = _lae(_lae(f"tv[i + 1] + {STILL}", f"CASE WHEN i = l - 1 THEN -1e30::DOUBLE ELSE tv[i + 2] + {ON} END"), f"CASE WHEN i = 0 THEN -1e30::DOUBLE ELSE tw[i] + {STEP_BACK} END")
LEFT_W = _lae(f"tw[i + 1] + {HALF_ODDS}", f"CASE WHEN i = l - 1 THEN -1e30::DOUBLE ELSE tv[i + 2] + {HALF_ODDS} END")
SQUIGGLE_GRADIENT = (
    SQUIGGLE_SUMS
    + f""", b AS (SELECT read_id, n.n AS t, l, list_transform(range(l), lambda i: CASE WHEN i = l - 1 THEN 0.0::DOUBLE ELSE -1e30::DOUBLE END) AS v, list_transform(range(l), lambda i: -1e30::DOUBLE) AS w FROM n
    UNION ALL SELECT read_id, t - 1, l, list_transform(range(l), lambda i: {LEFT_V}), list_transform(range(l), lambda i: {LEFT_W})
    FROM (SELECT b.read_id, b.t, l, list_transform(range(l), lambda i: v[i + 1] + {DENSITY}) AS tv, list_transform(range(l), lambda i: w[i + 1] + {DENSITY}) AS tw FROM b JOIN e ON e.read_id = b.read_id AND e.t = b.t - 1)),
  z AS (SELECT read_id, arg_max(v, t)[l] AS z FROM f GROUP BY read_id, l),
  j AS (SELECT e.read_id, value, f.v AS fv, g.v AS gv, g.w AS gw, b.v AS bv, b.w AS bw, z, unnest(range(f.l)) AS i
    FROM e JOIN f ON f.read_id = e.read_id AND f.t = e.t JOIN f g ON g.read_id = e.read_id AND g.t = e.t + 1 JOIN b ON b.read_id = e.read_id AND b.t = e.t + 1 JOIN z ON z.read_id = e.read_id),
  k AS (SELECT read_id, i, value - (20 + 15 * (i % 5)) AS d, exp(gv[i + 1] + bv[i + 1] - z) + exp(gw[i + 1] + bw[i + 1] - z) AS here,
      CASE WHEN i = 0 THEN 0 ELSE exp(fv[i] + bv[i + 1] + {DENSITY} - z) END - exp(fv[i + 1] + bv[i + 1] + {DENSITY} - z) AS moved FROM j)
  SELECT read_id, i AS pos, round(-sum(here * sign(d) * exp(-2.5::DOUBLE)), 6) + 0 AS location, round(-sum(here * (abs(d) * exp(-2.5::DOUBLE) - 1)), 6) + 0 AS logsd, round(-sum(moved) * (1 - 1e-15::DOUBLE) / 4, 6) + 0 AS rate FROM k GROUP BY read_id, i"""
)


@query("squiggle_gradient", SQUIGGLE_GRADIENT)
def squiggle_gradient(spark, sf_dir):
    """Of every level of a read the gradient of the cost by its location, log spread and rate."""
    g = aligning.squiggle_gradient(_signals(spark, sf_dir))
    return g.select("read_id", "pos", *[(F.round(c, 6) + 0.0).alias(c) for c in ("location", "logsd", "rate")])


# states: 0 before the levels, 1 to l in them, l + 1 after them, then in them after a step back; every
# state has its ways in and where they come from, the first of equal ones counts
WAYS = f"""CASE WHEN i = 0 THEN [u[1] + sm]
      WHEN i <= l THEN [u[i + 1] + {STILL}, u[i] + CASE WHEN i = 1 THEN om ELSE {ON} END, CASE WHEN i = 1 THEN -1e30::DOUBLE ELSE u[1] + om - 2.0::DOUBLE * (i - 1) END, CASE WHEN i = 1 THEN -1e30::DOUBLE ELSE u[l + i + 1] + {HALF_ODDS} END]
      WHEN i = l + 1 THEN list_concat([u[l + 2] + sm, u[l + 1] + {ON}], list_transform(range(1, l), lambda k: u[k + 1] + {ON} - 2.0::DOUBLE * (l - k)))
      ELSE [u[i + 1] + {HALF_ODDS}, CASE WHEN i - l - 2 < l - 1 THEN u[i - l + 1] + {STEP_BACK} ELSE -1e30::DOUBLE END] END"""
FROM = "CASE WHEN i = 0 THEN [i] WHEN i <= l THEN [i, i - 1, 0, l + i] WHEN i = l + 1 THEN list_concat([i, l], range(1, l)) ELSE [i, i - l] END"
FLOORED = f"greatest(-30.0::DOUBLE, {DENSITY.replace('i % 5', 'q % 5')})"
SQUIGGLE_PATH = (
    SIGNALS
    + f""", m AS (SELECT *, list_sum(list_transform(range(l), lambda i: {ON})) / l AS om, list_sum(list_transform(range(l), lambda i: {STILL})) / l AS sm FROM n),
  f AS (SELECT read_id, CAST(0 AS BIGINT) AS t, l, om, sm, list_transform(range(2 * l + 2), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE -1e30::DOUBLE END) AS u, list_transform(range(2 * l + 2), lambda i: CAST([] AS BIGINT[])) AS p FROM m
    UNION ALL SELECT read_id, t + 1, l, om, sm, list_transform(ways, lambda c, i: list_max(c) + CASE WHEN i = 1 OR i = l + 2 THEN -2.0::DOUBLE ELSE own[CASE WHEN i <= l + 1 THEN i - 1 ELSE i - l - 2 END] END),
      list_transform(ways, lambda c, i: list_append(p[origin[i][list_position(c, list_max(c))] + 1], i - 1))
    FROM (SELECT f.*, list_transform(range(2 * l + 2), lambda i: {WAYS}) AS ways, list_transform(range(2 * l + 2), lambda i: {FROM}) AS origin, list_transform(range(l), lambda q: {FLOORED}) AS own
      FROM f JOIN e ON e.read_id = f.read_id AND e.t = f.t)),
  z AS (SELECT read_id, l, arg_max(u, t) AS u, arg_max(p, t) AS p FROM f GROUP BY read_id, l),
  y AS (SELECT read_id, l, CASE WHEN u[l + 1] > u[l + 2] THEN l + 1 ELSE l + 2 END AS k, u, p FROM z),
  x AS (SELECT read_id, l, u[k] AS score, unnest(range(len(p[k]))) AS i, unnest(p[k]) AS s FROM y)
  SELECT read_id, i, CAST(CASE WHEN s = 0 OR s = l + 1 THEN -1 WHEN s > l + 1 THEN s - l - 2 ELSE s - 1 END AS BIGINT) AS pos, round(score, 6) AS score FROM x"""
)


@query("squiggle_viterbi", SQUIGGLE_PATH)
def squiggle_viterbi(spark, sf_dir):
    path, score = aligning.squiggle_path(_signals(spark, sf_dir), 2.0, minscore=30.0)
    return path.join(score, "read_id").select("read_id", F.col("t").alias("i"), "pos", F.round("score", 6).alias("score"))


KERNEL, SHIFT = np.round(np.sin(np.arange(27) + 1.0), 3).reshape(3, 3, 3), np.array([0.1, -0.5, 0.3])


def _level_sql() -> str:
    """CTEs of each base's three outputs, from the corners that the three bases around it stand for."""
    def term(o: int, k: int) -> str:
        whens = " ".join(f"WHEN '{b}' THEN {float(sum(w * c for w, c in zip(KERNEL[o, :, k], corner)))!r}::DOUBLE" for b, corner in squiggle.CORNERS.items())
        return f"CASE CASE WHEN p + {k - 1} >= 1 THEN substr(seq, CAST(p + {k - 1} AS BIGINT), 1) ELSE '' END {whens} ELSE 0 END"

    outs = ", ".join(f"{float(SHIFT[o])!r}::DOUBLE + " + " + ".join(term(o, k) for k in range(3)) + f" AS {n}" for o, n in enumerate(("current", "logsd", "rate")))
    return f"""d AS (SELECT doc_id AS read_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents),
  ids AS (SELECT DISTINCT user_id AS read_id FROM events),
  j AS (SELECT ids.read_id, seq, CASE WHEN seq IS NULL THEN 'reference not found' WHEN seq = '' THEN 'reference is empty' END AS error FROM ids LEFT JOIN d USING (read_id)),
  lv AS (SELECT read_id, p - 1 AS pos, substr(seq, CAST(p AS BIGINT), 1) AS base, {outs} FROM (SELECT read_id, seq, unnest(range(1, length(seq) + 1)) AS p FROM j WHERE error IS NULL))"""


def _squiggles(spark, sf_dir):
    """Reads (users of events) with their references (documents of the same number)."""
    reads = read(spark, sf_dir, "events").select(F.col("user_id").alias("read_id")).distinct()
    return squiggle.matched(reads, sequences(spark, sf_dir))


@query("reference_levels", "WITH " + _level_sql() + """ SELECT j.read_id, count(pos) AS bases, round(coalesce(sum(current), 0), 6) AS current, round(coalesce(sum(logsd), 0), 6) AS logsd, round(coalesce(sum(rate), 0), 6) AS rate, error
  FROM j LEFT JOIN lv USING (read_id) GROUP BY j.read_id, error""")
def reference_levels(spark, sf_dir):
    """What each read's reference predicts, added up; a read without a reference is an error row."""
    met = _squiggles(spark, sf_dir)
    found = squiggle.levels(met.where("error IS NULL"), KERNEL, SHIFT).groupBy("read_id").agg(F.count("*").alias("bases"), *[F.sum(c).alias(c) for c in ("current", "logsd", "rate")])
    return met.select("read_id", "error").join(found, "read_id", "left").select("read_id", F.coalesce("bases", F.lit(0)).alias("bases"), *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("current", "logsd", "rate")], "error")


@query("squiggle_path_table", S + ", " + _level_sql() + """, c AS (SELECT read_id, median(current) AS shift FROM s GROUP BY 1),
  m AS (SELECT s.read_id, any_value(shift) AS shift, 1.4826::DOUBLE * median(abs(current - shift)) AS scale FROM s JOIN c USING (read_id) GROUP BY 1),
  g AS (SELECT s.read_id, t AS i, (s.current - shift) / scale AS signal, t // 3 - 1 AS pos FROM s JOIN m USING (read_id) JOIN j USING (read_id) WHERE scale > 0 AND error IS NULL)
  SELECT g.read_id, i, round(signal, 6) AS signal, g.pos, base, round(lv.current, 6) AS current, round(logsd, 6) AS logsd, round(rate, 6) AS rate FROM g LEFT JOIN lv ON lv.read_id = g.read_id AND lv.pos = g.pos""")
def squiggle_path_table(spark, sf_dir):
    """The eight columns of every sample, along a path that moves on after each third one; it begins before the reference and may run past it."""
    found = squiggle.levels(_squiggles(spark, sf_dir).where("error IS NULL"), KERNEL, SHIFT)
    s = signal(spark, sf_dir)
    z = robust.normalise(s, robust.scaling_params(s)).join(_squiggles(spark, sf_dir).where("error IS NULL").select("read_id"), "read_id", "left_semi")
    path = z.select("read_id", F.col("t").alias("i"), F.col("z").alias("signal"), (F.floor(F.col("t") / 3) - 1).cast("long").alias("pos"))
    return squiggle.path_table(path, found).select("read_id", "i", F.round("signal", 6).alias("signal"), "pos", "base", *[F.round(c, 6).alias(c) for c in ("current", "logsd", "rate")])


@query("tetrahedral_embedding", "SELECT user_id AS read_id, round(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 1 ELSE -1 END) / sqrt(3.0::DOUBLE), 6) AS x, round(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 ELSE -1 END) / sqrt(3.0::DOUBLE), 6) AS y FROM events WHERE event_type <> 'view' GROUP BY 1")
def tetrahedral_embedding(spark, sf_dir):
    """Bases as corners of a tetrahedron, summed over a read in two of the axes."""
    corners = {"click": (1, 1), "error": (1, -1), "purchase": (-1, 1), "signup": (-1, -1)}
    at = F.create_map(*[x for k, v in corners.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    e = read(spark, sf_dir, "events").where("event_type != 'view'").withColumn("p", at[F.col("event_type")])
    return e.groupBy(F.col("user_id").alias("read_id")).agg(*[F.round(F.sum(F.col("p")[k]) / F.sqrt(F.lit(3.0)), 6).alias(n) for k, n in enumerate("xy")])


CHAIN = (
    POSTERIOR
    + ", lp AS (SELECT read_id, t, list_transform(p, lambda s: ln(s + 1e-8::DOUBLE)) AS x FROM p)"
    + _best_path("lp")
    + f""", w AS (SELECT read_id, t, state, lag(state) OVER (PARTITION BY read_id ORDER BY t) AS before FROM vit),
  c AS (SELECT w.read_id, w.t, state % {NB} AS b, post.p AS pp FROM w JOIN p AS post ON post.read_id = w.read_id AND w.t = post.t + 1 WHERE state <> before),
  q AS (SELECT read_id, t, b, 1 - (list_sum(pp[{2 * NB} * b + 1 : {2 * NB} * b + {2 * NB}]) + pp[{2 * NB * NB} + b + 1] + pp[{2 * NB * NB + NB} + b + 1]) / (list_sum(pp) + 1e-10::DOUBLE) AS perr FROM c)
  SELECT i.read_id, coalesce(string_agg(substr('ACGTZ', CAST(b AS INTEGER) + 1, 1), '' ORDER BY t), '') AS seq,
    coalesce(string_agg(chr(CAST(floor(-10 * log10(greatest(perr, 1e-5::DOUBLE)) + 33.5::DOUBLE) AS INTEGER)), '' ORDER BY t), '') AS qual, count(perr) AS n_moves
  FROM (SELECT DISTINCT read_id FROM e) i LEFT JOIN q ON q.read_id = i.read_id GROUP BY i.read_id"""
)


@query("basecall_chain", CHAIN)
def basecall_chain(spark, sf_dir):
    """Posteriors, best path, error probabilities and quality of each read's call."""
    logs = F.transform("post", lambda p: F.transform(p, lambda s: F.ln(s + 1e-8)))
    rows = _once(_posteriors(spark, sf_dir), path=P.viterbi(logs, NB))
    rows = _once(rows, err=P.error_probs(F.col("post"), NB, F.col("path")))
    after, before = F.slice("path", F.lit(2), F.size("steps")), F.slice("path", F.lit(1), F.size("steps"))
    calls = F.filter(F.arrays_zip(after.alias("s"), before.alias("b"), F.col("err").alias("e")), lambda c: c["s"] != c["b"])
    rows = _once(rows, calls=calls)
    letters = F.transform("calls", lambda c: F.element_at(F.array(*map(F.lit, "ACGTZ")), (c["s"] % NB + 1).cast("int")))
    marks = F.transform("calls", lambda c: qscore.to_char(-10 * F.log10(F.greatest(c["e"], F.lit(1e-5)))))
    return rows.select("read_id", F.array_join(letters, "").alias("seq"), F.array_join(marks, "").alias("qual"), F.size("calls").cast("long").alias("n_moves"))


@query("basecall_long", CHAIN.replace(STEPS, LONG))
def basecall_long(spark, sf_dir):
    """The chain of ``basecall_chain`` on three long reads, as rows of steps until the letters meet."""
    scores = _long(spark, sf_dir)
    calls = blocks.called(scores, NB)
    letter = F.element_at(F.array(*map(F.lit, "ACGTZ")), (F.col("base") + 1).cast("int"))
    mark = qscore.to_char(-10 * F.log10(F.greatest("error", F.lit(1e-5))))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", c))), lambda r: r["c"]), "")
    found = calls.groupBy("read_id").agg(joined(letter.alias("c")).alias("seq"), joined(mark.alias("c")).alias("qual"), F.count("*").alias("n_moves"))
    reads = scores.select("read_id").distinct()
    return reads.join(found, "read_id", "left").select("read_id", F.coalesce("seq", F.lit("")).alias("seq"), F.coalesce("qual", F.lit("")).alias("qual"), F.coalesce("n_moves", F.lit(0)).alias("n_moves"))
