"""Quality scores, alignment measures and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from porelake.catalog import query
from porelake.functions import qscore
from porelake.operators import alignment, joins
from porelake.plans._bind import read
from porelake.sources import bam
from porelake.storage import scratch_path

# a line item as an alignment: quantity bases matched, line number insertions, discount in percent
# deletions, tax in percent mismatches; its order is the read
A = """WITH a AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 10 AS m, CAST(l_linenumber AS BIGINT) AS i, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS nm FROM lineitem),
  v AS (SELECT *, (m + i + d - nm) / (m + i + d) AS accuracy, least(0.75::DOUBLE, nm / (m + i)) AS perr FROM a)"""


def alignments(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") * 10).alias("m"), F.col("l_linenumber").cast("long").alias("i"), F.round(F.col("l_discount") * 100).cast("long").alias("d"), F.round(F.col("l_tax") * 100).cast("long").alias("nm"))
    return li.withColumns(alignment.metrics(*(F.col(c) for c in ("m", "i", "d", "nm"))))


@query("qscore_from_errprob", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0 THEN round(-10 * log10(l_discount), 6) ELSE 50 END AS q FROM lineitem")
def qscore_from_errprob(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(qscore.from_error(F.col("l_discount"), 50.0), 6).alias("q"))


@query("qscore_chars", "SELECT l_orderkey, l_linenumber, l_partkey, chr(CAST(floor(least(40, -10 * log10(l_discount + 0.0001::DOUBLE)) + 33.5::DOUBLE) AS INTEGER)) AS qchar FROM lineitem")
def qscore_chars(spark, sf_dir):
    q = F.least(F.lit(40.0), qscore.from_error(F.col("l_discount") + 0.0001))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", qscore.to_char(q).alias("qchar"))


@query("mean_read_qscore", "SELECT l_orderkey, round(-10 * log10(avg(pow(10::DOUBLE, -l_quantity / 10))), 6) AS mean_q FROM lineitem GROUP BY 1")
def mean_read_qscore(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(qscore.mean_of_read(F.col("l_quantity")), 6).alias("mean_q"))


@query("transitions_into_base", "SELECT p_partkey, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS idx FROM (SELECT p_partkey, unnest(list_concat(range(8 * (p_size % 4), 8 * (p_size % 4) + 8), [32 + p_size % 4, 36 + p_size % 4])) AS k FROM part) GROUP BY 1")
def transitions_into_base(spark, sf_dir):
    idx = qscore.transitions_into(F.col("p_size") % 4, 4)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(idx).cast("array<string>"), ",").alias("idx"))


@query("alignment_metrics", A + """ SELECT l_orderkey, l_linenumber, m + i + d AS aligned, m + i + d - nm AS correct, round(accuracy, 9) AS accuracy, round((m + i + d - nm) / m, 9) AS identity,
  round(m * (2 + (1 - perr) * log2(1 - perr) + CASE WHEN nm > 0 THEN perr * log2(perr / 3) ELSE 0 END), 6) AS information FROM v""")
def alignment_metrics(spark, sf_dir):
    return alignments(spark, sf_dir).select("l_orderkey", "l_linenumber", "aligned", "correct", F.round("accuracy", 9).alias("accuracy"), F.round("identity", 9).alias("identity"), F.round("information", 6).alias("information"))


SUMMARY = "count(*) AS n, round(avg(accuracy), 6) AS mean, " + ", ".join(f"round(quantile_cont(accuracy, {p / 100}), 6) AS q{p}" for p in (5, 25, 50, 75, 95)) + ", round(avg(CASE WHEN accuracy > 0.9::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 6) AS frac_over_90, count(*) FILTER (accuracy > 0.9::DOUBLE) AS n_over_90, count(DISTINCT l_orderkey) AS n_mapped, round(sum(m * (2 + (1 - perr) * log2(1 - perr) + CASE WHEN nm > 0 THEN perr * log2(perr / 3) ELSE 0 END)) / 1e6, 6) AS ci_score"


@query("accuracy_summary", A + f" SELECT l_linenumber, {SUMMARY} FROM v GROUP BY l_linenumber")
def accuracy_summary(spark, sf_dir):
    s = alignment.summary(alignments(spark, sf_dir), by=["l_linenumber"], read="l_orderkey")
    return s.select("l_linenumber", *[F.round(c, 6).alias(c) if s.schema[c].dataType.typeName() == "double" else F.col(c) for c in s.columns[1:]])


@query("best_accuracy_per_read", A + " SELECT l_orderkey, l_linenumber, round(accuracy, 9) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY accuracy DESC, l_linenumber, m, nm, d) AS k FROM v) WHERE k = 1")
def best_accuracy_per_read(spark, sf_dir):
    rows = alignments(spark, sf_dir).withColumn("tie", F.struct("l_linenumber", "m", "nm", "d"))
    return joins.best_by(rows, ["l_orderkey"], "accuracy", "tie").select("l_orderkey", "l_linenumber", F.round("accuracy", 9).alias("accuracy"))


@query("accuracy_histogram", A + " SELECT CAST(least(floor((accuracy - 0.65::DOUBLE) * 35 / 0.35::DOUBLE), 34) AS INTEGER) AS bin, count(*) AS n FROM v WHERE accuracy BETWEEN 0.65::DOUBLE AND 1.0::DOUBLE GROUP BY 1")
def accuracy_histogram(spark, sf_dir):
    a = alignments(spark, sf_dir)
    lo, width = F.lit(0.65), F.lit(0.35)
    at = F.floor((F.col("accuracy") - lo) * 35 / width)
    return a.where((F.col("accuracy") >= 0.65) & (F.col("accuracy") <= 1.0)).groupBy(F.least(at, F.lit(34)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("accuracy_mode", A + """, i AS (SELECT accuracy AS a FROM v WHERE accuracy BETWEEN 0 AND 1), s AS (SELECT stddev_samp(a) * pow(count(*), -0.2::DOUBLE) AS h FROM i),
  c AS (SELECT floor(a * 512) AS cell, count(*) AS w FROM i GROUP BY 1), d AS (SELECT x, sum(w * exp(-0.5::DOUBLE * pow((x - cell - 0.5::DOUBLE) / 512 / h, 2))) AS d FROM c, s, range(513) r(x) GROUP BY x)
  SELECT round(arg_max(x, d) / 512.0::DOUBLE, 6) AS mode FROM d""")
def accuracy_mode(spark, sf_dir):
    return alignment.density_mode(alignments(spark, sf_dir), F.col("accuracy")).select(F.round("mode", 6).alias("mode"))


@query("throughput", "SELECT event_type, count(*) AS calls, round(sum(value) / 1000, 6) AS kilo, round(sum(value) / 1000 / (epoch(max(ts)) - epoch(min(ts))), 9) AS kilo_per_s FROM events GROUP BY 1")
def throughput(spark, sf_dir):
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value") / 1000, 6).alias("kilo"), F.round(F.sum("value") / 1000 / seconds, 9).alias("kilo_per_s"))


CAL = A + ", k AS (SELECT l_orderkey, accuracy, m / 60.0::DOUBLE + l_linenumber AS q, CASE WHEN accuracy >= 1 THEN 40 ELSE least(40, -10 * log10(1 - accuracy)) END AS q_align FROM v)"


def calibration(spark, sf_dir):
    a = alignments(spark, sf_dir)
    return a.select("l_orderkey", "accuracy", (F.col("m") / 60.0 + F.col("l_linenumber")).alias("q"), qscore.empirical(F.col("accuracy"), 40.0).alias("q_align"))


@query("qcal_filter", CAL + " SELECT count(*) AS n, round(avg(q), 6) AS mean_q, round(avg(q_align), 6) AS mean_q_align FROM k WHERE q >= 5 AND accuracy > 0.8::DOUBLE")
def qcal_filter(spark, sf_dir):
    return calibration(spark, sf_dir).where("q >= 5 AND accuracy > 0.8D").agg(F.count("*").alias("n"), F.round(F.avg("q"), 6).alias("mean_q"), F.round(F.avg("q_align"), 6).alias("mean_q_align"))


@query("qcal_ols", CAL + " SELECT round(regr_slope(q_align, q), 6) AS slope, round(regr_intercept(q_align, q), 6) AS intercept FROM k")
def qcal_ols(spark, sf_dir):
    return calibration(spark, sf_dir).agg(F.round(F.regr_slope("q_align", "q"), 6).alias("slope"), F.round(F.regr_intercept("q_align", "q"), 6).alias("intercept"))


def _huber_sql(rounds: int = 10, t: float = 1.345) -> str:
    """The rounds of the fit as CTEs in a row: weighted sums, the line, and the scale for the next round."""
    out = CAL + ", g0 AS (SELECT 0.0::DOUBLE AS slope, 0.0::DOUBLE AS level, CAST(NULL AS DOUBLE) AS scale)"
    for i in range(1, rounds + 1):
        weight = f"CASE WHEN scale IS NULL OR abs(r) <= {t}::DOUBLE * scale THEN 1.0::DOUBLE ELSE {t}::DOUBLE * scale / abs(r) END"
        out += f""", f{i} AS MATERIALIZED (SELECT sum(w) AS n, sum(w * q) AS sx, sum(w * y) AS sy, sum(w * q * q) AS xx, sum(w * q * y) AS xy
    FROM (SELECT q, y, {weight} AS w FROM (SELECT q, q_align AS y, scale, q_align - slope * q - level AS r FROM k, g{i - 1}))),
  h{i} AS MATERIALIZED (SELECT slope, (sy - slope * sx) / n AS level FROM (SELECT *, (n * xy - sx * sy) / (n * xx - sx * sx) AS slope FROM f{i})),
  g{i} AS MATERIALIZED (SELECT slope, level, greatest(1e-12::DOUBLE, median(abs(q_align - slope * q - level)) / 0.6745::DOUBLE) AS scale FROM k, h{i} GROUP BY slope, level)"""
    return out + f" SELECT (SELECT count(*) FROM k) AS n, round(slope, 6) AS slope, round(level, 6) AS intercept FROM g{rounds}"


@query("qcal_huber", _huber_sql())
def qcal_huber(spark, sf_dir):
    rows = calibration(spark, sf_dir)
    slope, level = alignment.huber_fit(rows, "q", "q_align")
    return rows.agg(F.count("*").alias("n"), F.lit(round(slope, 6)).alias("slope"), F.lit(round(level, 6)).alias("intercept"))


def _mode_sql() -> str:
    """The grid's best cell, then rounds of 33 probes around the best place."""
    out = A + """, i AS (SELECT accuracy AS a FROM v WHERE accuracy BETWEEN 0 AND 1), s AS (SELECT stddev_samp(a) * pow(count(*), -0.2::DOUBLE) AS h FROM i),
  c AS (SELECT floor(a * 512) AS cell, count(*) AS w FROM i GROUP BY 1), d AS (SELECT x, sum(w * exp(-0.5::DOUBLE * pow((x - cell - 0.5::DOUBLE) / 512 / h, 2))) AS d FROM c, s, range(513) r(x) GROUP BY x),
  b0 AS (SELECT arg_max(x, d) / 512.0::DOUBLE AS best FROM d)"""
    width, k = 1 / 512, 0
    while 2 * width > 1e-7:
        k += 1
        out += f""", p{k} AS MATERIALIZED (SELECT least(1.0::DOUBLE, greatest(0.0::DOUBLE, best - {width!r}::DOUBLE + x * {2 * width / 32!r}::DOUBLE)) AS p FROM b{k - 1}, range(33) r(x)),
  b{k} AS MATERIALIZED (SELECT arg_max(p, d) AS best FROM (SELECT p, sum(exp(-0.5::DOUBLE * pow((a - p) / h, 2))) AS d FROM i, s, p{k} GROUP BY p))"""
        width = 2 * width / 32
    return out + f" SELECT round(best, 5) AS mode FROM b{k}"


@query("accuracy_kernel_mode", _mode_sql())
def accuracy_kernel_mode(spark, sf_dir):
    return alignment.kernel_mode(alignments(spark, sf_dir), F.col("accuracy")).select(F.round("mode", 5).alias("mode"))


BAM_REFERENCES = [(f"chr{k}", 1 << 28) for k in range(5)]


@query("bam_alignment_metrics", A + """ SELECT l_orderkey, l_linenumber, 'chr' || (l_orderkey % 5) AS rname, m + i + d - nm AS correct, round(accuracy, 9) AS accuracy, count(*) AS records FROM v GROUP BY ALL""")
def bam_alignment_metrics(spark, sf_dir):
    """Line items written as records of BAM files in the shared folder, read back in splits and assessed."""
    a = alignments(spark, sf_dir)
    op = lambda c, code: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(code))).otherwise("")
    as_record = {
        "qname": F.concat_ws(":", "l_orderkey", "l_linenumber"), "flag": F.when(F.col("l_linenumber") % 2 == 0, 16).otherwise(0), "rname": F.concat(F.lit("chr"), (F.col("l_orderkey") % 5).cast("string")),
        "pos": (F.col("l_orderkey") + 1).cast("int"), "mapq": F.lit(60), "cigar": F.concat(op("m", "M"), op("i", "I"), op("d", "D")), "rnext": F.lit("*"), "pnext": F.lit(0), "tlen": F.lit(0),
        "seq": F.lit("*"), "qual": F.lit("*"), "tags": F.concat(F.lit("NM:i:"), F.col("nm").cast("string")),
    }
    path = scratch_path(spark, "bam")
    bam.write_bam(a.select(*[c.alias(n) for n, c in as_record.items()]), path, BAM_REFERENCES)
    found = alignment.of_sam(bam.read_bam(spark, path, split_bytes=1 << 18))
    key = F.split("qname", ":")
    rows = found.select(key[0].cast("long").alias("l_orderkey"), key[1].cast("int").alias("l_linenumber"), "rname", "correct", F.round("accuracy", 9).alias("accuracy"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("records"))


@query("scaled_qscores", A + """ SELECT l_orderkey, string_agg(chr(CAST(floor(least(90.0::DOUBLE, greatest(0.0::DOUBLE, 1.1::DOUBLE * q - 0.5::DOUBLE)) + 33.5::DOUBLE) AS INTEGER)), '' ORDER BY l_linenumber, q) AS qual
  FROM (SELECT l_orderkey, l_linenumber, CASE WHEN perr > 0 THEN -10 * log10(perr) ELSE 50 END AS q FROM v) GROUP BY l_orderkey""")
def scaled_qscores(spark, sf_dir):
    """A read's quality string after its scores are scaled and shifted; an alignment stands for a base."""
    a = alignments(spark, sf_dir)
    q = qscore.from_error(F.least(F.lit(0.75), F.col("nm") / (F.col("m") + F.col("i"))), 50.0)
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", q.alias("q"))))
    scaled = F.transform(rows, lambda r: qscore.to_char(F.least(F.lit(90.0), F.greatest(F.lit(0.0), qscore.scaled(r["q"], 1.1, -0.5)))))
    return a.groupBy("l_orderkey").agg(F.array_join(scaled, "").alias("qual"))
