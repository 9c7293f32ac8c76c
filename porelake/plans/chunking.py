"""Mapped reads: regions, checks, chunks, filters, samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from porelake.catalog import query
from porelake.operators import chunks, mapping, robust, scans
from porelake.plans._bind import M, S, mapped_reads, read, signal
from porelake.storage import materialize

R2S, SIGLEN = F.col, None


@query("mapped_regions", M + """, k AS (SELECT read_id, siglen, list_transform(r2s, lambda v, i: CASE WHEN i <= 3 THEN -1 WHEN i > len(r2s) - 2 THEN siglen + 1 ELSE v END) AS r FROM m)
  SELECT read_id, CAST(list_min(list_filter(list_transform(r, lambda v, i: CASE WHEN v >= 0 AND v <= siglen THEN i - 1 END), lambda x: x IS NOT NULL)) AS INTEGER) AS r_first,
  CAST(list_max(list_filter(list_transform(r, lambda v, i: CASE WHEN v >= 0 AND v <= siglen THEN i - 1 END), lambda x: x IS NOT NULL)) AS INTEGER) AS r_last,
  list_filter(r, lambda v: v >= 0 AND v <= siglen)[1] AS s_first, list_filter(r, lambda v: v >= 0 AND v <= siglen)[-1] AS s_last FROM k""")
def mapped_regions(spark, sf_dir):
    """Regions of reads whose first three and last two entries are clipped."""
    n, m = F.size("dacs"), F.size("ref_to_signal")
    clipped = F.transform("ref_to_signal", lambda v, i: F.when(i < 3, -1).when(i >= m - 2, n + 1).otherwise(v))
    rows = mapped_reads(spark, sf_dir).select("read_id", clipped.alias("r"), n.alias("n"))
    ref, sig = mapping.mapped_reference_region(F.col("r"), F.col("n")), mapping.mapped_signal_region(F.col("r"), F.col("n"))
    return rows.select("read_id", ref["first"].alias("r_first"), ref["last"].alias("r_last"), sig["first"].alias("s_first"), sig["last"].alias("s_last"))


@query("mapping_check", M + """ SELECT CASE WHEN read_id % 4 = 0 THEN 'reference and map differ in length' WHEN read_id % 4 = 1 THEN 'map beyond the signal' ELSE 'pass' END AS message, count(*) AS n FROM m GROUP BY 1""")
def mapping_check(spark, sf_dir):
    """Half of the reads are spoilt, in two ways, and must be told."""
    bad = F.when(F.col("read_id") % 4 == 1, F.concat(F.slice("ref_to_signal", F.lit(1), F.size("ref_to_signal") - 1), F.array(F.size("dacs") + 5))).otherwise(F.col("ref_to_signal"))
    ref = F.when(F.col("read_id") % 4 == 0, F.slice("reference", F.lit(1), F.size("reference") - 1)).otherwise(F.col("reference"))
    return mapped_reads(spark, sf_dir).groupBy(mapping.check(ref, bad, F.size("dacs")).alias("message")).agg(F.count("*").alias("n"))


@query("reference_interval", M + " SELECT read_id, CAST(len(list_filter(r2s, lambda v: v <= 10)) - 1 AS INTEGER) AS r0, CAST(len(list_filter(r2s, lambda v: v < 40)) AS INTEGER) AS r1 FROM m")
def reference_interval(spark, sf_dir):
    x = mapping.reference_interval(F.col("ref_to_signal"), F.lit(10), F.lit(40))
    return mapped_reads(spark, sf_dir).select("read_id", x["first"].alias("r0"), x["last"].alias("r1"))


@query("reference_interval_rows", """WITH b AS (SELECT user_id AS read_id, event_id AS loc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events WHERE event_type IN ('purchase', 'view')),
  k AS (SELECT user_id AS read_id, event_id AS start, event_id + 500 AS "end" FROM events WHERE event_type = 'click'),
  r AS (SELECT k.read_id, k.start, k."end", coalesce(min(b.loc), 0) AS lo, coalesce(max(b.loc), 0) AS hi, count(*) FILTER (b.loc <= k.start) - 1 AS first, count(*) FILTER (b.loc < k."end") AS last FROM k LEFT JOIN b USING (read_id) GROUP BY ALL)
  SELECT read_id, start, "end", CASE WHEN error IS NULL THEN first END AS first, CASE WHEN error IS NULL THEN last END AS last, error
  FROM (SELECT *, CASE WHEN start < lo THEN 'before the mapped region' WHEN start > hi OR "end" > hi THEN 'after the mapped region' END AS error FROM r)""")
def reference_interval_rows(spark, sf_dir):
    """A user's purchases and views are the bases of a read, at the samples that event ids number; every
    click asks for the 500 samples from it on."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("read_id"), F.col("event_id").alias("loc"), "event_type")
    bases = scans.numbered(e.where(F.col("event_type").isin("purchase", "view")), ["read_id"], "loc", 65_536, "i")
    asked = e.where("event_type = 'click'").select("read_id", F.col("loc").alias("start"), (F.col("loc") + 500).alias("end"))
    reads = bases.groupBy("read_id").agg(F.max("loc").alias("siglen"))
    return mapping.reference_intervals(asked, bases, reads, width=65_536)


DWELL = ", dw AS (SELECT read_id, unnest(list_transform(range(1, len(r2s)), lambda i: r2s[i + 1] - r2s[i])) AS d FROM m)"


@query("dwell_percentiles", M + DWELL + " SELECT read_id, round(avg(d), 6) AS mean_dwell, max(d) AS max_dwell, round(quantile_cont(d, 0.5), 6) AS q50, round(quantile_cont(d, 0.95), 6) AS q95 FROM dw GROUP BY 1")
def dwell_percentiles(spark, sf_dir):
    bases = mapping.align_bases(mapped_reads(spark, sf_dir))
    return bases.groupBy("read_id").agg(F.round(F.avg("dwell"), 6).alias("mean_dwell"), F.max("dwell").alias("max_dwell"), *[F.round(F.percentile("dwell", F.lit(p / 100)), 6).alias(f"q{p}") for p in (50, 95)])


@query("label_composition", M + ", c AS (SELECT unnest(reference) AS code FROM m) SELECT CAST(code AS SMALLINT) AS code, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM c GROUP BY code")
def label_composition(spark, sf_dir):
    c = mapping.align_bases(mapped_reads(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))
    return c.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # one row a label


@query("read_metrics", M + " SELECT median(len(reference)) AS reflen, median(siglen) AS siglen, count(*) AS n FROM m")
def read_metrics(spark, sf_dir):
    reads = mapped_reads(spark, sf_dir).select(F.size("reference").alias("r"), F.size("dacs").alias("s"))
    found = robust.quantiles(robust.melted(reads, ["r", "s"]), F.col("value"), [0.5], ["name"])
    of = lambda c: F.max(F.when(F.col("name") == c, F.col("quantiles")[0]))
    return found.agg(of("r").alias("reflen"), of("s").alias("siglen"), F.max("n").alias("n"))


@query("path_to_signal_map", S + """, k AS (SELECT read_id, code, t * 2 - 1 + 3 AS loc, t, count(*) OVER (PARTITION BY read_id) * 2 AS siglen FROM s WHERE code <> 4)
  SELECT read_id, count(*) AS n, CAST(min(loc) AS BIGINT) AS first_loc, CAST(max(loc) AS BIGINT) AS last_loc FROM k WHERE loc >= 0 AND loc < siglen GROUP BY read_id""")
def path_to_signal_map(spark, sf_dir):
    """Labels as entries of a path at stride 2; 'view' stands for clipped entries."""
    s = signal(spark, sf_dir).where("code != 4").withColumn("siglen", F.count("*").over(Window.partitionBy("read_id")) * 2)
    path = s.select("read_id", F.col("t").alias("k"), F.col("code").alias("ref"), F.lit(3).alias("trim_start"), "siglen")
    return mapping.path_to_signal(path, 2, ["read_id"]).groupBy("read_id").agg(F.count("*").alias("n"), F.min("loc").alias("first_loc"), F.max("loc").alias("last_loc"))


INVERT = S + """, p AS (SELECT read_id, t AS loc, CAST(max(t // 3) OVER (PARTITION BY read_id ORDER BY t) AS INTEGER) AS ref FROM s WHERE t % 5 <> 4 AND t >= 6),
  e AS (SELECT read_id, min(ref) AS f, max(ref) AS l, max(loc) AS v FROM p GROUP BY 1),
  n AS (SELECT read_id, CAST(count(*) AS INTEGER) AS siglen, CAST(count(*) // 3 + 3 AS INTEGER) AS reflen FROM s GROUP BY 1),
  r AS (SELECT read_id, siglen, unnest(range(reflen + 1)) AS r FROM n)
  SELECT r.read_id, CAST(r.r AS INTEGER) AS r, CAST(CASE WHEN f IS NULL OR r.r < f THEN -1 WHEN r.r <= l THEN (SELECT min(loc) FROM p WHERE p.read_id = r.read_id AND p.ref >= r.r) WHEN r.r = l + 1 THEN v + 1 ELSE siglen + 1 END AS INTEGER) AS loc
  FROM r LEFT JOIN e USING (read_id)"""


@query("ref_to_signal", INVERT)
def ref_to_signal(spark, sf_dir):
    s = signal(spark, sf_dir)
    mapped = s.where("t % 5 != 4 AND t >= 6").select("read_id", F.col("t").alias("loc"), F.floor(F.col("t") / 3).cast("int").alias("ref"))
    reads = s.groupBy("read_id").agg(F.count("*").alias("siglen"), (F.floor(F.count("*") / 3) + 3).cast("int").alias("reflen"))
    return mapping.invert(mapped, reads)


WINDOWS = S + """, n AS (SELECT read_id, CAST(count(*) AS INTEGER) AS n FROM s GROUP BY 1),
  e AS (SELECT read_id, n, unnest(list_append(CASE WHEN n > 30 THEN list_transform(range(30, n, 20), lambda x: CAST(x AS INTEGER)) ELSE [] END, n)) AS "end" FROM n),
  c AS (SELECT read_id, greatest(0, "end" - 30) AS start, "end" FROM e)"""


@query("chunk_windows", WINDOWS + ' SELECT read_id, CAST(start AS INTEGER) AS start, "end" FROM c')
def chunk_windows(spark, sf_dir):
    n = signal(spark, sf_dir).groupBy("read_id").agg(F.count("*").cast("int").alias("n"))
    return n.select("read_id", F.explode(chunks.overlapping_windows(F.col("n"), 30, 10)).alias("c")).select("read_id", "c.start", "c.end")


@query("stitch_bounds", WINDOWS + """, b AS (SELECT read_id, start, "end", lag("end") OVER w AS pe, lead(start) OVER w AS ns FROM c WINDOW w AS (PARTITION BY read_id ORDER BY start, "end"))
  SELECT read_id, CAST(start AS INTEGER) AS start, "end", CAST(CASE WHEN pe IS NULL THEN start // 5 ELSE (pe - start) // 10 END AS BIGINT) AS lo,
  CAST(CASE WHEN ns IS NULL THEN ("end" - start) // 5 ELSE ("end" + ns - 2 * start) // 10 END AS BIGINT) AS hi FROM b""")
def stitch_bounds(spark, sf_dir):
    return chunks.stitch_bounds(chunk_windows(spark, sf_dir), 5)


STITCHED = WINDOWS + """, b AS (SELECT read_id, start, "end", lag("end") OVER w AS pe, lead(start) OVER w AS ns FROM c WINDOW w AS (PARTITION BY read_id ORDER BY start, "end")),
  k AS (SELECT read_id, start, "end", unnest(range(CASE WHEN pe IS NULL THEN start // 5 ELSE (pe - start) // 10 + {0} END, CASE WHEN ns IS NULL THEN ("end" - start) // 5 ELSE ("end" + ns - 2 * start) // 10 END + {0})) AS k FROM b)
  SELECT read_id, row_number() OVER (PARTITION BY read_id ORDER BY start, "end", k) - 1 AS t, CAST(start + 5 * k AS INTEGER) AS value FROM k WHERE k < ("end" - start) // 5 + {0}"""


def _stitched(spark, sf_dir, path):
    """Every step of a chunk's output says at which sample it stands."""
    steps = F.floor((F.col("end") - F.col("start")) / 5).cast("int") - (0 if path else 1)
    out = F.when(steps >= 0, F.transform(F.sequence(F.lit(0), steps), lambda k: F.col("start") + 5 * k)).otherwise(F.array().cast("array<int>"))
    return chunks.stitch(chunk_windows(spark, sf_dir).withColumn("out", out), 5, path=path)


@query("stitch_outputs", STITCHED.format(0))
def stitch_outputs(spark, sf_dir):
    return _stitched(spark, sf_dir, False)


@query("stitch_paths", STITCHED.format(1))
def stitch_paths(spark, sf_dir):
    return _stitched(spark, sf_dir, True)


FIXED = M + """, g AS (SELECT read_id, dacs, r2s, siglen, list_filter(r2s, lambda v: v >= 0 AND v <= siglen)[1] AS d0, list_filter(r2s, lambda v: v >= 0 AND v <= siglen)[-1] AS d1, CAST(read_id % 30 AS INTEGER) AS s FROM m),
  x AS (SELECT *, s + d0 AS start_sample, CASE WHEN d1 = 0 THEN 'nullmapping' WHEN d1 - d0 - 40 <= 0 OR s >= d1 - d0 - 40 THEN 'tooshort' END AS reason FROM g),
  y AS (SELECT *, CASE WHEN reason IS NULL THEN len(list_filter(r2s, lambda v: v <= start_sample)) - 1 END AS r0, CASE WHEN reason IS NULL THEN len(list_filter(r2s, lambda v: v < start_sample + 40)) END AS r1 FROM x),
  z AS (SELECT *, r1 - r0 AS seq_len, CASE WHEN reason IS NULL THEN 40 END AS sig_len, CASE WHEN r1 - r0 = 1 THEN 1 WHEN r1 - r0 > 1 THEN list_max(list_transform(range(r0 + 1, r1), lambda i: r2s[i + 1] - r2s[i])) END AS max_dwell FROM y)"""


def _chunks(spark, sf_dir):
    return chunks.fixed_samples(mapped_reads(spark, sf_dir), 40, (F.col("read_id") % 30).cast("int"))


@query("chunk_fixed_samples", FIXED + " SELECT read_id, start_sample, CAST(coalesce(r0, -1) AS INTEGER) AS r0, CAST(coalesce(r1, -1) AS INTEGER) AS r1, CAST(coalesce(seq_len, -1) AS INTEGER) AS seq_len, CAST(coalesce(max_dwell, -1) AS INTEGER) AS max_dwell, coalesce(reason, 'none') AS reject_reason FROM z")
def chunk_fixed_samples(spark, sf_dir):
    return _chunks(spark, sf_dir).select("read_id", "start_sample", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("r0", "r1", "seq_len", "max_dwell")], F.coalesce("reject_reason", F.lit("none")).alias("reject_reason"))


@query("chunk_fixed_bases", M + """, g AS (SELECT read_id, r2s, CAST(len(reference) AS INTEGER) AS n, CAST(read_id % 20 AS INTEGER) AS s FROM m)
  SELECT read_id, s AS r0, s + 25 AS r1, r2s[s + 1] AS start_sample, r2s[s + 26] - r2s[s + 1] AS sig_len FROM g WHERE n - 25 > 0 AND s < n - 25""")
def chunk_fixed_bases(spark, sf_dir):
    c = chunks.fixed_bases(mapped_reads(spark, sf_dir), 25, (F.col("read_id") % 20).cast("int"))
    return c.where("reject_reason IS NULL").select("read_id", "r0", "r1", "start_sample", "sig_len")


PARAMS = ", d AS (SELECT 40 / (seq_len + 1e-8::DOUBLE) AS dwell FROM z WHERE reason IS NULL), pm AS (SELECT median(dwell) AS med FROM d), pr AS (SELECT any_value(med) AS med, 1.4826::DOUBLE * median(abs(dwell - med)) AS mad FROM d, pm)"
REASON = "CASE WHEN reason IS NOT NULL THEN reason WHEN 40 / seq_len::DOUBLE <= 1.1::DOUBLE THEN 'pathbuffer' WHEN abs(40 / (seq_len + 1e-8::DOUBLE) - med) > 1.0::DOUBLE * mad THEN 'meandwell' WHEN max_dwell > 4.0::DOUBLE * med THEN 'maxdwell' ELSE 'pass' END"


def _filtered(spark, sf_dir):
    c = materialize(_chunks(spark, sf_dir).select("read_id", "sig_len", "seq_len", "max_dwell", "reject_reason"), "chunks")
    dwell = c.where("reject_reason IS NULL").select(chunks.mean_dwell(F.col("sig_len"), F.col("seq_len")).alias("dwell"))
    p = robust.med_mad(dwell, "dwell", []).first()
    return chunks.apply_filters(c, F.lit(p.med), F.lit(p.mad), 1, f_mean=1.0, f_max=4.0), p


@query("chunk_filter_params", FIXED + PARAMS + " SELECT round(med, 6) AS med, round(mad, 6) AS mad FROM pr")
def chunk_filter_params(spark, sf_dir):
    c = _chunks(spark, sf_dir).where("reject_reason IS NULL").select(chunks.mean_dwell(F.col("sig_len"), F.col("seq_len")).alias("dwell"))
    return robust.med_mad(c, "dwell", []).select(F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"))


@query("chunk_filter_reasons", FIXED + PARAMS + f" SELECT read_id, {REASON} AS reason FROM z, pr")
def chunk_filter_reasons(spark, sf_dir):
    return _filtered(spark, sf_dir)[0].select("read_id", F.coalesce("reject_reason", F.lit("pass")).alias("reason"))


@query("reject_tally", FIXED + PARAMS + f" SELECT {REASON} AS reason, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, {REASON}) AS INTEGER) AS place FROM z, pr GROUP BY 1")
def reject_tally(spark, sf_dir):
    return chunks.reject_tally(_filtered(spark, sf_dir)[0])


@query("squiggle_boxes", M + DWELL.replace("AS d FROM m", "AS d, read_id AS rid FROM m") .replace(", dw AS (SELECT read_id, unnest(", ", dw AS (SELECT read_id, unnest(range(1, len(r2s))) AS i, unnest(").replace(" AS d, read_id AS rid FROM m", " AS d FROM m") + " SELECT read_id, CAST(i - 1 AS INTEGER) AS i, round(sum(d) OVER (PARTITION BY read_id ORDER BY i) - d / 2.0::DOUBLE, 6) AS centre FROM dw")
def squiggle_boxes(spark, sf_dir):
    """Centre of each base's box in a plot of a squiggle: cumulative dwell minus half its own."""
    b = mapping.align_bases(mapped_reads(spark, sf_dir))
    w = Window.partitionBy("read_id").orderBy("i")
    return b.select("read_id", "i", F.round(F.sum("dwell").over(w) - F.col("dwell") / 2, 6).alias("centre"))


@query("chunk_dwell_percentiles", FIXED + ", p AS (SELECT 40 / (seq_len + 1e-8::DOUBLE) AS mean_dwell, max_dwell FROM z WHERE reason IS NULL) SELECT q, round(quantile_cont(mean_dwell, q / 100.0::DOUBLE), 6) AS mean_dwell, quantile_cont(max_dwell, q / 100.0::DOUBLE) AS max_dwell FROM p, (SELECT unnest([5, 25, 50, 75, 95]) AS q) GROUP BY q".replace("quantile_cont(mean_dwell, q / 100.0::DOUBLE)", "CASE q WHEN 5 THEN quantile_cont(mean_dwell, 0.05) WHEN 25 THEN quantile_cont(mean_dwell, 0.25) WHEN 50 THEN quantile_cont(mean_dwell, 0.5) WHEN 75 THEN quantile_cont(mean_dwell, 0.75) ELSE quantile_cont(mean_dwell, 0.95) END").replace("quantile_cont(max_dwell, q / 100.0::DOUBLE)", "round(CASE q WHEN 5 THEN quantile_cont(max_dwell, 0.05) WHEN 25 THEN quantile_cont(max_dwell, 0.25) WHEN 50 THEN quantile_cont(max_dwell, 0.5) WHEN 75 THEN quantile_cont(max_dwell, 0.75) ELSE quantile_cont(max_dwell, 0.95) END, 6)"))
def chunk_dwell_percentiles(spark, sf_dir):
    c = _chunks(spark, sf_dir).where("reject_reason IS NULL").select(chunks.mean_dwell(F.col("sig_len"), F.col("seq_len")).alias("mean_dwell"), "max_dwell")
    qs = (5, 25, 50, 75, 95)
    found = robust.quantiles(robust.melted(c, ["mean_dwell", "max_dwell"]), F.col("value"), [q / 100 for q in qs], ["name"])
    of = lambda x: F.max(F.when(F.col("name") == x, F.col("quantiles")))
    both = found.agg(of("mean_dwell").alias("a"), of("max_dwell").alias("b"))
    rows = both.select(F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("a"), F.col("b"))).alias("x"))
    return rows.select("x.q", F.round("x.a", 6).alias("mean_dwell"), F.round("x.b", 6).alias("max_dwell"))
