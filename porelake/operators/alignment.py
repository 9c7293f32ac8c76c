"""Alignment accuracy, its summaries, and calibration of quality scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porelake.functions.sequence import cigar_total
from porelake.operators import robust
from porelake.storage import materialize


def metrics(m: Column, i: Column, d: Column, nm: Column) -> dict[str, Column]:
    """Measures of one alignment from its matched (M), inserted and deleted bases and edit distance."""
    aligned = m + i + d
    perr = F.least(F.lit(0.75), nm / (m + i))
    pmatch = 1 - perr
    info = 2 + pmatch * F.log2(pmatch) + F.when(nm > 0, perr * F.log2(perr / 3)).otherwise(0.0)
    return {"aligned": aligned, "correct": aligned - nm, "accuracy": (aligned - nm) / aligned, "identity": (aligned - nm) / m, "information": m * info}


def of_sam(sam: DataFrame, min_coverage: float = 0.6, read_ids: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """Measures of the mapped primary records of a SAM table; their coverage is at least min_coverage.
    Where given, only records of ``read_ids`` (qname), and of ``references`` (rname)."""
    for known, key in ((read_ids, "qname"), (references, "rname")):
        sam = sam if known is None else sam.join(known.select(key), key, "left_semi")
    m, i, d, clip = (cigar_total(F.col("cigar"), op) for op in "MIDS")
    rows = sam.where(F.col("flag").isin(0, 16) & (F.col("cigar") != "*")).select("qname", "rname", "flag", "pos", m.alias("m"), i.alias("i"), d.alias("d"), clip.alias("clip"), F.regexp_extract("tags", r"NM:i:(\d+)", 1).cast("long").alias("nm"))
    coverage = (F.col("m") + F.col("i")) / (F.col("m") + F.col("i") + F.col("clip"))
    found = metrics(*(F.col(c) for c in ("m", "i", "d", "nm")))
    return rows.withColumn("coverage", coverage).where(F.col("coverage") >= min_coverage).withColumns(found)


def summary(df: DataFrame, accuracy: str = "accuracy", by: list[str] | None = None, read: str | None = None, percents: tuple[int, ...] = (5, 25, 50, 75, 95)) -> DataFrame:
    """Mean, percentiles and counts of accuracies; with the column of the read also how many reads are
    mapped, and their information in millions of bits. Percentiles are selected by radix, reads are
    counted once for each group before they are added up: nothing but counts and sums is shuffled."""
    by = by or ["_all"]
    rows = df.withColumn("_all", F.lit(0)) if by == ["_all"] else df
    a = F.col(accuracy)
    sums = [F.count("*").alias("n"), F.avg(a).alias("mean"), F.avg(F.when(a > 0.9, 1.0).otherwise(0.0)).alias("frac_over_90"), F.count_if(a > 0.9).alias("n_over_90")]
    sums += [(F.sum("information") / 1e6).alias("ci_score")] if read else []
    found = rows.agg(*sums).withColumn("_all", F.lit(0)) if by == ["_all"] else rows.groupBy(*by).agg(*sums)  # a row without groups even of no rows
    q = robust.quantiles(rows, a, [p / 100 for p in percents], by)
    same = lambda other: [found[c].eqNullSafe(other[c]) for c in by]
    out = found.join(q, same(q), "left").select(*[found[c] for c in found.columns], q["quantiles"])
    reads = []
    if read:
        m = rows.groupBy(*by, read).agg(F.lit(1)).groupBy(*by).agg(F.count(read).alias("n_mapped"))
        out = out.join(m, [out[c].eqNullSafe(m[c]) for c in by], "left").select(*[out[c] for c in out.columns], F.coalesce(m["n_mapped"], F.lit(0)).alias("n_mapped"))
        reads = ["n_mapped", "ci_score"]
    named = [F.col("quantiles")[k].alias(f"q{p}") for k, p in enumerate(percents)]
    return out.select(*[c for c in by if c != "_all"], "n", "mean", *named, "frac_over_90", "n_over_90", *reads)


def histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n): equal bins of [lo, hi], the last one closed at both ends."""
    at = F.floor((value - lo) * bins / (hi - lo))
    return df.where((value >= lo) & (value <= hi)).groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def density_mode(df: DataFrame, value: Column, lo: float = 0.0, hi: float = 1.0, grid: int = 512) -> DataFrame:
    """(mode): where a Gaussian kernel density is highest, on a grid. Values are first counted in the
    grid's cells, so the densities cost grid x grid whatever the number of rows."""
    v = value.cast("double")
    inside = df.where((v >= lo) & (v <= hi)).select(v.alias("v"))
    stats = inside.agg(F.stddev_samp("v").alias("sd"), F.count("*").alias("n"))
    width = (hi - lo) / grid
    cells = inside.groupBy(F.floor((F.col("v") - lo) / width).alias("cell")).agg(F.count("*").alias("w"))
    at = cells.crossJoin(F.broadcast(stats)).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(grid))))  # one row of statistics
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    u = (F.lit(lo) + F.col("x") * width - (F.lit(lo) + (F.col("cell") + 0.5) * width)) / h
    dens = at.groupBy("x").agg(F.sum(F.col("w") * F.exp(-0.5 * u * u)).alias("d"))
    return dens.agg((F.lit(lo) + F.max_by("x", "d") * width).alias("mode"))


def kernel_mode(df: DataFrame, value: Column, lo: float = 0.0, hi: float = 1.0, grid: int = 512, probes: int = 33, within: float = 1e-7) -> DataFrame:
    """(mode): where the Gaussian kernel density of the values is highest, to ``within``. The grid's
    best cell is refined: each round sums the kernels of all values at ``probes`` places of the span
    around the best one, in one aggregation. Null without values; all values alike are the mode."""
    v = value.cast("double")
    inside = materialize(df.where((v >= lo) & (v <= hi)).select(v.alias("v")), "kernel-mode")
    sd, n = inside.agg(F.stddev_samp("v"), F.count("*")).first()
    if not n or not sd:
        return inside.agg(F.min("v").alias("mode"))
    h, width = sd * n**-0.2, (hi - lo) / grid
    best = density_mode(inside, F.col("v"), lo, hi, grid).first()[0]
    while 2 * width > within:
        at = [min(hi, max(lo, best - width + k * (2 * width / (probes - 1)))) for k in range(probes)]
        sums = inside.agg(*[F.sum(F.exp(-0.5 * F.pow((F.col("v") - F.lit(x)) / F.lit(h), 2))).alias(f"d{k}") for k, x in enumerate(at)]).first()
        best, width = at[max(range(probes), key=lambda k: (sums[k], -k))], 2 * width / (probes - 1)
    return df.sparkSession.range(1).select(F.lit(best).alias("mode"))


def huber_fit(df: DataFrame, x: str, y: str, t: float = 1.345, rounds: int = 10) -> tuple[float, float]:
    """Slope and intercept of y ~ x by iteratively reweighted least squares with Huber weights and a
    MAD scale, about zero. A round is one aggregation and a radix selection over a written table; only
    sums and counts reach the driver. Rows where either is null, NaN or infinite take no part."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = materialize(rows.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))), "huber")  # NaN is larger than any number
    slope, level, scale = 0.0, 0.0, None
    for k in range(rounds):
        left = F.abs(F.col("y") - slope * F.col("x") - level)
        if k:
            scale = max(1e-12, robust.exact_quantiles(rows, left, [0.5])[0] / 0.6745)
        w = F.lit(1.0) if scale is None else F.when(left <= t * scale, 1.0).otherwise(t * scale / left)
        s = rows.select("x", "y", w.alias("w")).agg(*[F.sum(c).alias(n) for n, c in (("n", F.col("w")), ("sx", F.expr("w*x")), ("sy", F.expr("w*y")), ("xx", F.expr("w*x*x")), ("xy", F.expr("w*x*y")))]).first()
        if not s.n:
            return float("nan"), float("nan")
        det = s.n * s.xx - s.sx * s.sx
        slope = (s.n * s.xy - s.sx * s.sy) / det if det else 0.0
        level = (s.sy - slope * s.sx) / s.n
    return slope, level


def summary_text(found: DataFrame, mode: float | None, name: str, percents: tuple[int, ...] = (5, 25, 50, 75, 95)) -> DataFrame:
    """(line, value): the report of one ``summary`` row without groups, as lines of a .summary file."""
    blank, n = F.lit(""), F.col("n_mapped")
    quantiles = F.concat_ws("    ", *[F.format_string("%.5f", f"q{p}") for p in percents])
    lines = [
        F.lit(f"*** Summary report for {name} ***"),
        F.concat(F.lit("Number of mapped reads: "), n.cast("string")),
        F.concat(F.lit("Mean accuracy: "), F.format_string("%.5f", "mean")),
        F.lit(f"Mode accuracy: {mode:.5f}") if mode is not None else F.lit("Mode accuracy: none"),
        F.lit("Accuracy quantiles:"),
        F.lit("  " + "".join(f"Q{p:<11}" for p in percents).strip()),
        F.concat(F.lit("  "), quantiles),
        F.concat(F.lit("Proportion with accuracy >90%: "), F.format_string("%.5f", "frac_over_90")),
        F.concat(F.lit("Number with accuracy >90%: "), F.col("n_over_90").cast("string")),
        F.concat(F.lit("CIscore (Mbits): "), F.format_string("%.5f", "ci_score")),
        blank,
    ]
    empty = F.array(F.lit(f"*** Summary report for {name} ***"), F.lit("No sequences mapped"), blank)
    return found.select(F.posexplode(F.when(F.col("n") > 0, F.array(*lines)).otherwise(empty)).alias("line", "value"))
