"""Robust scaling, coding of runs, and rolling statistics of signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from porelake.catalog import query
from porelake.operators import rolling, robust, runs
from porelake.operators import signal as signal_of
from porelake.plans._bind import DIGITISATION, M, N, OFFSET, RANGE, S, mapped_reads, read, signal
from porelake.storage import scratch_path

PARAMS = S + """, c AS (SELECT read_id, median(current) AS shift FROM s GROUP BY 1), p AS (
  SELECT s.read_id, any_value(shift) AS shift, 1.4826::DOUBLE * median(abs(current - shift)) AS scale
  FROM s JOIN c USING (read_id) GROUP BY 1)"""


@query("med_mad_by_read", PARAMS + " SELECT read_id, round(shift, 9) AS shift, round(scale, 9) AS scale FROM p WHERE scale > 0")
def med_mad_by_read(spark, sf_dir):
    return robust.scaling_params(signal(spark, sf_dir)).select("read_id", F.round("shift", 9).alias("shift"), F.round("scale", 9).alias("scale"))


@query("normalise_signal", PARAMS + """ SELECT read_id, round(any_value(shift), 9) AS shift, round(any_value(scale), 9) AS scale,
  count(*) AS n, round(avg((current - shift) / scale), 6) AS mean_z, round(max((current - shift) / scale), 6) AS max_z
  FROM s JOIN p USING (read_id) WHERE scale > 0 GROUP BY read_id""")
def normalise_signal(spark, sf_dir):
    s = signal(spark, sf_dir)
    z = robust.normalise(s, robust.scaling_params(s))
    return z.groupBy("read_id").agg(F.round(F.first("shift"), 9).alias("shift"), F.round(F.first("scale"), 9).alias("scale"), F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("mean_z"), F.round(F.max("z"), 6).alias("max_z"))


@query("global_med_mad", """WITH m AS (SELECT median(l_extendedprice) AS med FROM lineitem)
  SELECT round(any_value(med), 6) AS med, round(1.4826::DOUBLE * median(abs(l_extendedprice - med)), 6) AS mad FROM lineitem, m""")
def global_med_mad(spark, sf_dir):
    return robust.med_mad(read(spark, sf_dir, "lineitem"), "l_extendedprice", []).select(F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"))


@query("logsumexp_by_key", S + " SELECT read_id, round(max(current) + ln(sum(exp(current - top))), 6) AS lse FROM (SELECT *, max(current) OVER (PARTITION BY read_id) AS top FROM s) GROUP BY read_id")
def logsumexp_by_key(spark, sf_dir):
    return robust.logsumexp(signal(spark, sf_dir), "current", ["read_id"]).select("read_id", F.round("lse", 6).alias("lse"))


@query("dac_to_pa", S + f" SELECT read_id, t, (round(current * 100) + {OFFSET}::DOUBLE) * {RANGE}::DOUBLE / {DIGITISATION}::DOUBLE AS pa FROM s")
def dac_to_pa(spark, sf_dir):
    pa = robust.to_picoamps(F.round(F.col("current") * 100), F.lit(OFFSET), F.lit(RANGE), F.lit(DIGITISATION))
    return signal(spark, sf_dir).select("read_id", "t", pa.alias("pa"))


@query("trim_absolute", M + """ SELECT read_id, CAST(len(x) AS INTEGER) AS n, x[1] AS head, x[len(x)] AS tail FROM (
  SELECT read_id, CASE WHEN 60 >= siglen THEN dacs ELSE dacs[21 : siglen - 40] END AS x FROM m)""")
def trim_absolute(spark, sf_dir):
    x = robust.trim(F.col("dacs"), F.lit(20), F.lit(40))
    return mapped_reads(spark, sf_dir).select("read_id", x.alias("x")).select("read_id", F.size("x").alias("n"), F.col("x")[0].alias("head"), F.element_at("x", -1).alias("tail"))


@query("signals", M + f""", g AS (SELECT read_id, dacs, siglen, read_id % 11 - 1 AS ts, CASE WHEN read_id % 5 = 0 THEN 1000000 ELSE read_id % 3 END AS te, 80.0::DOUBLE + read_id % 4 AS shift, CASE WHEN read_id % 7 = 0 THEN 1.0::DOUBLE ELSE 12.5::DOUBLE END AS scale FROM m),
  k AS (SELECT *, ts + te >= siglen AS nothing, CASE WHEN ts < 0 THEN 'a trim is negative' END AS error FROM g),
  c AS (SELECT *, list_transform(CASE WHEN nothing THEN dacs ELSE dacs[ts + 1 : siglen - te] END, lambda d: (d + {OFFSET}::DOUBLE) * {RANGE}::DOUBLE / {DIGITISATION}::DOUBLE) AS pa FROM k)
  SELECT read_id, CASE WHEN error IS NULL THEN CAST(CASE WHEN nothing THEN 0 ELSE ts END AS INTEGER) END AS start, CASE WHEN error IS NULL THEN CAST(CASE WHEN nothing THEN siglen ELSE siglen - te END AS INTEGER) END AS "end",
    4000.0::DOUBLE AS sampling_rate, CASE WHEN error IS NULL THEN round(list_sum(pa), 6) END AS current, CASE WHEN error IS NULL THEN round((list_sum(pa) - shift * len(pa)) / scale, 6) END AS standardised, error FROM c""")
def signals(spark, sf_dir):
    """Reads joined to a channel each and to parameters, some of which trim too much, or a negative amount."""
    reads = mapped_reads(spark, sf_dir).select("read_id", "dacs")
    channels = reads.select("read_id", F.lit(OFFSET).alias("offset"), F.lit(RANGE).alias("range"), F.lit(DIGITISATION).alias("digitisation"))
    r = F.col("read_id")
    params = reads.select("read_id", (r % 11 - 1).cast("int").alias("trim_start"), F.when(r % 5 == 0, 1000000).otherwise((r % 3).cast("int")).alias("trim_end"), (80.0 + r % 4).alias("shift"), F.when(r % 7 != 0, 12.5).alias("scale"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 6).alias(c)
    return signal_of.signals(reads, channels, params).select("read_id", "start", "end", "sampling_rate", total("current"), total("standardised"), "error")


RUNS = ", r AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY t) - 1 AS run FROM (SELECT *, coalesce({}, true) AS opens FROM s))"


@query("rle_labels", S + RUNS.format("code <> lag(code) OVER (PARTITION BY read_id ORDER BY t)") + " SELECT read_id, CAST(run AS BIGINT) AS run, min(t) AS start, any_value(code) AS value, count(*) AS length FROM r GROUP BY read_id, run")
def rle_labels(spark, sf_dir):
    return runs.run_lengths(signal(spark, sf_dir), "code", ["read_id"])


@query("rle_tolerance", S + RUNS.format("abs(current - lag(current) OVER (PARTITION BY read_id ORDER BY t)) > 25") + " SELECT read_id, CAST(run AS BIGINT) AS run, min(t) AS start, arg_min(current, t) AS value, count(*) AS length FROM r GROUP BY read_id, run")
def rle_tolerance(spark, sf_dir):
    return runs.run_lengths(signal(spark, sf_dir), "current", ["read_id"], tol=25.0)


CODES = S + RUNS.format("code <> lag(code) OVER (PARTITION BY read_id ORDER BY t)") + f", f AS (SELECT read_id, t, code AS label, row_number() OVER (PARTITION BY read_id, run ORDER BY t) % 2 = 0 AS flop, CAST(code + CASE WHEN row_number() OVER (PARTITION BY read_id, run ORDER BY t) % 2 = 0 THEN {N} ELSE 0 END AS INTEGER) AS ff FROM r)"


@query("flopmask", CODES + " SELECT read_id, t, flop FROM f")
def flopmask(spark, sf_dir):
    return runs.flop_mask(signal(spark, sf_dir), "code", ["read_id"]).select("read_id", "t", "flop")


@query("flipflop_code", CODES + " SELECT read_id, t, ff FROM f")
def flipflop_code(spark, sf_dir):
    s = signal(spark, sf_dir).withColumnRenamed("code", "label")
    return runs.flipflop_code(s, "label", N, ["read_id"]).select("read_id", "t", F.col("code").alias("ff"))


@query("move_stay_indices", CODES + f" SELECT read_id, t, CAST(ff + least(lead(ff) OVER (PARTITION BY read_id ORDER BY t), {N}) * {2 * N} AS INTEGER) AS move, CAST(ff + least(ff, {N}) * {2 * N} AS INTEGER) AS stay FROM (SELECT *, lead(ff) OVER (PARTITION BY read_id ORDER BY t) AS nx FROM f) WHERE nx IS NOT NULL".replace("lead(ff) OVER (PARTITION BY read_id ORDER BY t), 5", "nx, 5"))
def move_stay_indices(spark, sf_dir):
    s = signal(spark, sf_dir).withColumnRenamed("code", "label")
    coded = runs.flipflop_code(s, "label", N, ["read_id"])
    return runs.move_stay(coded, "code", N, ["read_id"]).where(F.col("move").isNotNull()).select("read_id", "t", "move", "stay")


@query("path_to_str", CODES + " SELECT read_id, string_agg(substr('ACGTZ', ff % 5 + 1, 1), '' ORDER BY t) AS seq FROM (SELECT *, lag(ff) OVER (PARTITION BY read_id ORDER BY t) AS b FROM f) WHERE b IS NULL OR b <> ff GROUP BY read_id")
def path_to_str(spark, sf_dir):
    s = signal(spark, sf_dir).withColumnRenamed("code", "label")
    coded = runs.flipflop_code(s, "label", N, ["read_id"])
    return runs.path_to_sequence(coded, "code", "ACGTZ", ["read_id"])


@query("mod_weights_at_moves", """WITH e AS (SELECT vec_id // 10 AS read_id, vec_id % 10 AS t, embedding, CAST(abs(label) % 4 AS INTEGER) AS state FROM embeddings),
  x AS (SELECT *, lag(state) OVER (PARTITION BY read_id ORDER BY t) AS b FROM e)
  SELECT read_id, t, state AS base, CASE state WHEN 0 THEN round(embedding[2]::DOUBLE, 6) WHEN 1 THEN round(embedding[4]::DOUBLE, 6) END AS weight FROM x WHERE b <> state""")
def mod_weights_at_moves(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("read_id"), (F.col("vec_id") % 10).cast("long").alias("t"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), (F.abs("label") % 4).cast("int").alias("state"))
    return runs.modified_scores(e, "state", "x", 4, [1, 1, 0, 0], ["read_id"]).select("read_id", "t", "base", F.round(F.get("mod_scores", F.lit(0)), 6).alias("weight"))


@query("rolling_quantile", S + " SELECT read_id, t, round(CASE WHEN count(*) OVER w < 10 THEN 0 ELSE quantile_cont(current, 0.95) OVER w END, 6) AS q FROM s WINDOW w AS (PARTITION BY read_id ORDER BY t ROWS 99 PRECEDING)")
def rolling_quantile(spark, sf_dir):
    return signal(spark, sf_dir).select("read_id", "t", F.round(rolling.rolling_quantile(F.col("current"), 0.05, ["read_id"], "t", default=0.0), 6).alias("q"))


@query("rolling_mad", S + """, w AS (SELECT read_id, t, list(current) OVER (PARTITION BY read_id ORDER BY t ROWS 10 PRECEDING) AS xs FROM s)
  SELECT read_id, t, round(CASE WHEN len(xs) < 11 THEN 0 ELSE list_median(xs) + 3 * 1.4826::DOUBLE * list_median(list_transform(xs, lambda v: abs(v - list_median(xs)))) END, 6) AS threshold FROM w""")
def rolling_mad(spark, sf_dir):
    return signal(spark, sf_dir).select("read_id", "t", F.round(rolling.rolling_mad_threshold(F.col("current"), 3.0, ["read_id"], "t", window=11, default=0.0), 6).alias("threshold"))


@query("exp_smoother", S + """, w AS (SELECT read_id, t, list(current) OVER (PARTITION BY read_id ORDER BY t ROWS 19 PRECEDING) AS xs FROM s)
  SELECT read_id, t, round(list_sum(list_transform(xs, lambda v, i: v * pow(0.9::DOUBLE, len(xs) - i))) / list_sum(list_transform(xs, lambda v, i: pow(0.9::DOUBLE, len(xs) - i))), 6) AS smooth FROM w""")
def exp_smoother(spark, sf_dir):
    return signal(spark, sf_dir).select("read_id", "t", F.round(rolling.exponential_smoother(F.col("current"), 0.9, ["read_id"], "t", window=20), 6).alias("smooth"))


@query("moving_average", S + " SELECT read_id, t, round(avg(current) OVER (PARTITION BY read_id ORDER BY t ROWS 9 PRECEDING), 6) AS mean FROM s")
def moving_average(spark, sf_dir):
    return signal(spark, sf_dir).select("read_id", "t", F.round(rolling.moving_average(F.col("current"), ["read_id"], "t", 10), 6).alias("mean"))


@query("delta_sample", S + " SELECT read_id, t, round(coalesce(lead(current) OVER (PARTITION BY read_id ORDER BY t) - current, 0), 6) AS delta FROM s")
def delta_sample(spark, sf_dir):
    return signal(spark, sf_dir).select("read_id", "t", F.round(rolling.delta(F.col("current"), ["read_id"], "t"), 6).alias("delta"))


@query("window_embed", S + " SELECT read_id, t, coalesce(lag(current) OVER w, 0) AS x0, current AS x1, coalesce(lead(current) OVER w, 0) AS x2 FROM s WINDOW w AS (PARTITION BY read_id ORDER BY t)")
def window_embed(spark, sf_dir):
    cols = rolling.neighbours(F.col("current"), ["read_id"], "t", 3)
    return signal(spark, sf_dir).select("read_id", "t", *[c.alias(f"x{k}") for k, c in enumerate(cols)])


@query("studentise", S + " SELECT read_id, t, round((current - avg(current) OVER w) / sqrt(var_pop(current) OVER w + 1e-4), 6) AS z FROM s WINDOW w AS (PARTITION BY read_id)")
def studentise(spark, sf_dir):
    return signal(spark, sf_dir).select("read_id", "t", F.round(robust.studentise(F.col("current"), ["read_id"]), 6).alias("z"))


@query("lr_schedules", """SELECT event_id AS step, round(0.1::DOUBLE + 0.9::DOUBLE * least(1.0::DOUBLE, event_id / 5000.0::DOUBLE), 9) AS linear,
  round(1000.0::DOUBLE / (event_id + 1000.0::DOUBLE), 9) AS decay, round(0.001::DOUBLE + 0.5::DOUBLE * (0.1::DOUBLE - 0.001::DOUBLE) * (1 + cos(pi() * least(1.0::DOUBLE, event_id / 5000.0::DOUBLE))), 9) AS cosine FROM events""")
def lr_schedules(spark, sf_dir):
    step = F.col("event_id")
    return read(spark, sf_dir, "events").select(step.alias("step"), F.round(rolling.linear_schedule(step, 0.1, 1.0, 5000), 9).alias("linear"), F.round(rolling.inverse_decay(step, 1000.0), 9).alias("decay"), F.round(rolling.cosine_schedule(step, 0.001, 0.1, 5000), 9).alias("cosine"))


@query("training_log", S + """, g AS (SELECT read_id, t, current AS loss, quantile_cont(current, 0.95) OVER (PARTITION BY read_id ORDER BY t ROWS 49 PRECEDING) AS cap FROM s)
  SELECT read_id, t // 50 AS block, count(*) AS n, round(avg(loss), 6) AS mean_loss, count(*) FILTER (loss > cap) AS n_capped FROM g GROUP BY 1, 2""")
def training_log(spark, sf_dir):
    s = signal(spark, sf_dir)
    cap = F.percentile("current", F.lit(0.95)).over(rolling.trailing(["read_id"], "t", 50))
    return s.withColumn("cap", cap).groupBy("read_id", F.floor(F.col("t") / 50).alias("block")).agg(F.count("*").alias("n"), F.round(F.avg("current"), 6).alias("mean_loss"), F.count_if(F.col("current") > F.col("cap")).alias("n_capped"))


@query("qc_median_of_medians", PARAMS + " SELECT median(shift) AS med, round(median(scale), 9) AS mad, count(*) AS reads FROM p")
def qc_median_of_medians(spark, sf_dir):
    p = robust.med_mad(signal(spark, sf_dir), "current", ["read_id"])
    found = robust.quantiles(robust.melted(p, ["med", "mad"]), F.col("value"), [0.5], ["name"])
    of = lambda c: F.max(F.when(F.col("name") == c, F.col("quantiles")[0]))
    return found.agg(of("med").alias("med"), F.round(of("mad"), 9).alias("mad"), F.max("n").alias("reads"))


@query("stream_rolling_mean", "SELECT user_id AS key, row_number() OVER w AS n, value, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING), 9) AS statistic FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def stream_rolling_mean(spark, sf_dir):
    """The online form over a stream of the events' file, one micro-batch at a time; rows and state
    go to the shared folder."""
    from porelake.streaming.rolling import OUTPUT
    from porelake.streaming.rolling import rolling as online

    source = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*").selectExpr("user_id AS key", "value", "event_id AS order")
    folder = scratch_path(spark, "stream-rolling")
    sink = online(stream, "mean", window=10).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{folder}/rows").withColumn("statistic", F.round("statistic", 9))
