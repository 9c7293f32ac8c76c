"""Sequence functions over the bases that documents spell."""

from __future__ import annotations

from pyspark.sql import functions as F

from porelake.catalog import query
from porelake.functions import sequence
from porelake.operators import alphabets, joins
from porelake.plans._bind import Q, M, S, mapped_reads, read, sequences, signal

WQ = f"WITH q AS ({Q})"


@query("complement", WQ + " SELECT read_id, translate(seq, 'ACGT', 'TGCA') AS comp FROM q")
def complement(spark, sf_dir):
    return sequences(spark, sf_dir).select("read_id", sequence.complement(F.col("seq")).alias("comp"))


@query("revcomp", WQ + " SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM q")
def revcomp(spark, sf_dir):
    return sequences(spark, sf_dir).select("read_id", sequence.reverse_complement(F.col("seq")).alias("rc"))


@query("collapse_mods", "SELECT doc_id AS read_id, translate(regexp_replace(upper(text), '[^ACGTZY]', '', 'g'), 'ZY', 'CA') AS seq FROM documents")
def collapse_mods(spark, sf_dir):
    seq = F.regexp_replace(F.upper("text"), "[^ACGTZY]", "")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), sequence.collapse(seq, "ZY", "CA").alias("seq"))


@query("encode_int", WQ + """ SELECT read_id, CAST(len(seq) AS INTEGER) AS n,
  CAST(coalesce(list_sum(list_transform(string_split(seq, ''), lambda c: instr('ACGT', c) - 1)), 0) AS BIGINT) AS total FROM q WHERE seq <> ''""")
def encode_int(spark, sf_dir):
    codes = sequence.encode(F.col("seq"), "ACGT")
    return sequences(spark, sf_dir).where("seq != ''").select("read_id", F.length("seq").alias("n"), F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("decode_int", M + " SELECT read_id, array_to_string(list_transform(reference, lambda c: substr('ACGTZ', c + 1, 1)), '') AS seq FROM m")
def decode_int(spark, sf_dir):
    return mapped_reads(spark, sf_dir).select("read_id", sequence.decode(F.col("reference"), "ACGTZ").alias("seq"))


@query("base_composition", WQ + " SELECT base, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM (SELECT unnest(string_split(seq, '')) AS base FROM q WHERE seq <> '') GROUP BY base")
def base_composition(spark, sf_dir):
    counts = [F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).alias(b) for b in "ACGT"]
    one = sequences(spark, sf_dir).agg(*counts)
    tall = one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("n")) for b in "ACGT"])).alias("x"), sum((F.col(b) for b in "ACGT"), F.lit(0)).alias("total"))
    return tall.select("x.base", "x.n", F.round(100.0 * F.col("x.n") / F.col("total"), 6).alias("percent")).where("n > 0")


@query("ambig_filter", "SELECT page_id, length(url) AS n FROM pages WHERE NOT regexp_matches(upper(url), '[^A-Z0-9:/.?=&#_-]') AND regexp_matches(upper(url), '^[A-Z]+')")
def ambig_filter(spark, sf_dir):
    url = F.upper("url")
    return read(spark, sf_dir, "pages").where(~sequence.has_ambiguity(url, "A-Z0-9:/.?=&#_-") & url.rlike("^[A-Z]+")).select("page_id", F.length("url").cast("long").alias("n"))


@query("ambig_flatten", "SELECT item_id, upper(regexp_replace(text, '[^ACGTacgt]', 'N', 'g')) AS seq FROM benchmark")
def ambig_flatten(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.upper(sequence.flatten_ambiguity(F.col("text"), "ACGTacgt")).alias("seq"))


@query("iupac_motif_count", WQ + ", o AS (SELECT read_id, seq, unnest(range(length(seq) - 2)) AS i FROM q WHERE length(seq) >= 3) SELECT read_id, count(*) AS n FROM o WHERE regexp_matches(substr(seq, i + 1, 3), '^[AG][CT][AGCT]$') GROUP BY read_id")
def iupac_motif_count(spark, sf_dir):
    # a look-ahead finds overlapping matches in one pass of the regex engine
    found = F.size(F.regexp_extract_all("seq", F.lit(f"(?=({sequence.iupac_regex('RYN')}))"), F.lit(1))).cast("long")
    return sequences(spark, sf_dir).select("read_id", found.alias("n")).where("n > 0")


@query("motif_offsets", WQ + ", o AS (SELECT read_id, seq, unnest(range(length(seq) - 3)) AS i FROM q WHERE length(seq) >= 4) SELECT read_id, CAST(i AS INTEGER) AS at FROM o WHERE regexp_matches(substr(seq, i + 1, 4), '^C[AT][AT]G$')")
def motif_offsets(spark, sf_dir):
    return sequences(spark, sf_dir).select("read_id", F.explode(sequence.motif_offsets(F.col("seq"), "CWWG")).alias("at"))


@query("motif_logodds", S + """, x AS (SELECT read_id, t, code, lag(code) OVER w AS up, lead(code) OVER w AS down FROM s WINDOW w AS (PARTITION BY read_id ORDER BY t)),
  bg AS (SELECT code AS b, count(*) / sum(count(*)) OVER () AS f FROM s GROUP BY code),
  nb AS (SELECT -1 AS pos, up AS b FROM x WHERE code = 2 AND up IS NOT NULL UNION ALL SELECT 1, down FROM x WHERE code = 2 AND down IS NOT NULL)
  SELECT CAST(pos AS INTEGER) AS pos, b AS base, count(*) AS n, round(ln(count(*) / sum(count(*)) OVER (PARTITION BY pos) / any_value(f)), 6) AS logodds FROM nb JOIN bg USING (b) GROUP BY pos, b""")
def motif_logodds(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("read_id").orderBy("t")
    x = signal(spark, sf_dir).withColumns({"up": F.lag("code").over(w), "down": F.lead("code").over(w)})
    counts = x.groupBy(F.col("code").alias("base")).agg(F.count("*").alias("bg"))
    bg = counts.select("base", (F.col("bg") / F.sum("bg").over(Window.partitionBy())).alias("f"))  # one row a base
    around = x.where("code = 2").select(F.explode(F.array(F.struct(F.lit(-1).alias("pos"), F.col("up").alias("base")), F.struct(F.lit(1).alias("pos"), F.col("down").alias("base")))).alias("x")).select("x.*").where("base IS NOT NULL")
    at = around.groupBy("pos", "base").agg(F.count("*").alias("n")).join(F.broadcast(bg), "base")  # at most one row a base
    share = F.col("n") / F.sum("n").over(Window.partitionBy("pos"))
    return at.select("pos", "base", "n", F.round(F.ln(share / F.col("f")), 6).alias("logodds"))


@query("cigar_totals", """WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) || 'M' || (l_linenumber % 3) || 'I' || CAST(l_quantity * 2 AS INTEGER) || 'M' || CAST(round(l_discount * 100) AS INTEGER) || 'D' AS cigar FROM lineitem)
  SELECT l_orderkey, l_linenumber, list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)M', 1), lambda x: CAST(x AS BIGINT)))::BIGINT AS m,
  list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)I', 1), lambda x: CAST(x AS BIGINT)))::BIGINT AS i, list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)D', 1), lambda x: CAST(x AS BIGINT)))::BIGINT AS d FROM c""")
def cigar_totals(spark, sf_dir):
    cigar = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M"), (F.col("l_linenumber") % 3).cast("string"), F.lit("I"), (F.col("l_quantity") * 2).cast("int").cast("string"), F.lit("M"), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("D"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[sequence.cigar_total(cigar, op).alias(op.lower()) for op in "MID"])


@query("alphabet_merge_conflicts", """SELECT o_orderstatus AS mod, count(DISTINCT o_orderpriority) AS n_canonical, count(DISTINCT substr(o_orderpriority, 1, 1)) AS n_names, count(DISTINCT o_orderpriority) > 1 OR count(DISTINCT substr(o_orderpriority, 1, 1)) > 1 AS conflict FROM orders GROUP BY 1""")
def alphabet_merge_conflicts(spark, sf_dir):
    mods = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("mod"), F.col("o_orderpriority").alias("canonical"), F.substring("o_orderpriority", 1, 1).alias("long_name"))
    return alphabets.mod_conflicts(mods)


@query("alphabet_sorted", "SELECT DISTINCT p_type AS canonical, p_brand AS code, CAST(dense_rank() OVER (ORDER BY p_type, p_brand) - 1 AS INTEGER) AS position FROM part")
def alphabet_sorted(spark, sf_dir):
    mods = read(spark, sf_dir, "part").select(F.col("p_type").alias("canonical"), F.col("p_brand").alias("code")).distinct()
    return alphabets.sort_alphabet(mods)


MOD_COUNTS = S + ", c AS (SELECT code % 3 AS canonical, count(*) FILTER (code < 3) AS n_can, count(*) FILTER (code >= 3) AS n_mod FROM s GROUP BY 1)"


@query("mod_weights_inverse_frequency", MOD_COUNTS + " SELECT CAST(canonical AS INTEGER) AS canonical, n_can, n_mod, round(n_can / n_mod, 6) AS weight FROM c WHERE n_mod > 0")
def mod_weights_inverse_frequency(spark, sf_dir):
    """Labels 3 and 4 are modifications of 0 and 1."""
    c = signal(spark, sf_dir).groupBy((F.col("code") % 3).alias("canonical")).agg(F.count_if(F.col("code") < 3).alias("n_can"), F.count_if(F.col("code") >= 3).alias("n_mod"))
    return c.where("n_mod > 0").select("canonical", "n_can", "n_mod", F.round(F.col("n_can") / F.col("n_mod"), 6).alias("weight"))


@query("mod_weights_log_odds", MOD_COUNTS + " SELECT CAST(canonical AS INTEGER) AS canonical, round(pow(n_can / nullif(n_mod, 0), 0.5::DOUBLE), 6) AS mod_weight, round(pow(n_mod / n_can, 0.5::DOUBLE), 6) AS can_weight FROM c")
def mod_weights_log_odds(spark, sf_dir):
    c = signal(spark, sf_dir).groupBy((F.col("code") % 3).alias("canonical")).agg(F.count_if(F.col("code") < 3).alias("n_can"), F.count_if(F.col("code") >= 3).alias("n_mod"))
    power = lambda a, b: F.round(F.pow(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.5)), 6)
    return c.select("canonical", power("n_can", "n_mod").alias("mod_weight"), power("n_mod", "n_can").alias("can_weight"))


# brands are files, types canonical bases, sizes modulo 4 their modifications (0: the base itself)
AB = """WITH x AS (SELECT DISTINCT p_brand AS file, p_type AS canonical, p_size % 4 AS m FROM part UNION SELECT p_brand, p_type, 0 FROM part),
  ab AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY canonical, m) - 1 AS position, CASE WHEN m = 0 THEN canonical ELSE canonical || ':' || m END AS base, canonical, CASE WHEN m > 0 THEN 'name ' || (m % 3) || canonical END AS long_name FROM x)"""


def _alphabets(spark, sf_dir):
    from pyspark.sql import Window

    part = read(spark, sf_dir, "part")
    x = part.select(F.col("p_brand").alias("file"), F.col("p_type").alias("canonical"), (F.col("p_size") % 4).alias("m"))
    x = x.union(x.select("file", "canonical", F.lit(0))).distinct()
    base = F.when(F.col("m") == 0, F.col("canonical")).otherwise(F.concat("canonical", F.lit(":"), F.col("m").cast("string")))
    name = F.when(F.col("m") > 0, F.concat(F.lit("name "), (F.col("m") % 3).cast("string"), "canonical"))
    return x.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("canonical", "m")) - 1).alias("position"), base.alias("base"), "canonical", name.alias("long_name"))


@query("alphabet_labels", AB + """, c AS (SELECT *, min(position) FILTER (base = canonical) OVER (PARTITION BY file, canonical) AS collapse_label, count(*) FILTER (base <> canonical) OVER (PARTITION BY file, canonical) AS n_mods FROM ab),
  g AS (SELECT file, canonical, row_number() OVER (PARTITION BY file ORDER BY collapse_label) - 1 AS can_label, sum(n_mods + 1) OVER (PARTITION BY file ORDER BY collapse_label) - n_mods - 1 AS "offset" FROM (SELECT DISTINCT file, canonical, collapse_label, n_mods FROM c))
  SELECT c.file, base, CAST(collapse_label AS INTEGER) AS collapse_label, CAST(can_label AS INTEGER) AS can_label, CASE WHEN base = c.canonical THEN 0 ELSE row_number() OVER (PARTITION BY c.file, c.canonical, base <> c.canonical ORDER BY position) END AS mod_label, n_mods, CAST("offset" AS BIGINT) AS "offset" FROM c JOIN g ON g.file = c.file AND g.canonical = c.canonical""")
def alphabet_labels(spark, sf_dir):
    return alphabets.labels(_alphabets(spark, sf_dir)).select("file", "base", "collapse_label", "can_label", "mod_label", "n_mods", "offset")


@query("alphabet_renamed", AB + """ SELECT file, CAST(position AS INTEGER) AS position, CASE WHEN base = canonical THEN replace(canonical, 'S', 'Z') WHEN base LIKE '%:1' THEN base || '!' ELSE base END AS base, replace(canonical, 'S', 'Z') AS canonical, replace(long_name, 'name 1', 'label 1') AS long_name FROM ab""")
def alphabet_renamed(spark, sf_dir):
    ab = _alphabets(spark, sf_dir)
    of = lambda kind, old, new, rows: rows.select(F.lit(kind).alias("kind"), F.col(old).alias("old"), new.alias("new")).distinct()
    renames = of("canonical", "canonical", F.replace(F.col("canonical"), F.lit("S"), F.lit("Z")), ab).union(of("modified", "base", F.concat("base", F.lit("!")), ab.where("base LIKE '%:1'"))).union(of("long_name", "long_name", F.replace(F.col("long_name"), F.lit("name 1"), F.lit("label 1")), ab.where("long_name LIKE 'name 1%'")))
    return alphabets.renamed(ab, renames)


@query("alphabet_gate", AB + ", s AS (SELECT file, string_agg(concat_ws('=', base, canonical, long_name), ',' ORDER BY position) AS spelled FROM ab GROUP BY file) SELECT count(*) AS n_files, count(DISTINCT spelled) AS n_alphabets, count(DISTINCT spelled) <= 1 AS equal FROM s")
def alphabet_gate(spark, sf_dir):
    return alphabets.all_equal(_alphabets(spark, sf_dir))


# as a merge sees them where files disagree: the long name lacks its base
ODD = AB + ", o AS (SELECT base, CASE WHEN file LIKE '%1' AND base LIKE '%:3' THEN '?' || base ELSE canonical END AS canonical, substr(long_name, 1, 8) AS long_name FROM ab WHERE base <> canonical)"


@query("alphabet_conflicts", ODD + " SELECT 'canonical bases of a modified base' AS rule, base AS what, count(DISTINCT canonical) AS n FROM o GROUP BY base HAVING count(DISTINCT canonical) > 1 UNION ALL SELECT 'long names of a modified base', base, count(DISTINCT long_name) FROM o GROUP BY base HAVING count(DISTINCT long_name) > 1 UNION ALL SELECT 'modified bases of a long name', long_name, count(DISTINCT base) FROM o GROUP BY long_name HAVING count(DISTINCT base) > 1")
def alphabet_conflicts(spark, sf_dir):
    ab = _alphabets(spark, sf_dir)
    canonical = F.when(F.col("file").endswith("1") & F.col("base").endswith(":3"), F.concat(F.lit("?"), "base")).otherwise(F.col("canonical"))
    return alphabets.conflicts(ab.where(alphabets.is_mod()).withColumn("canonical", canonical).withColumn("long_name", F.substring("long_name", 1, 8)))


@query("alphabet_merged", AB + ", u AS (SELECT base, min(canonical) AS canonical, min(long_name) AS long_name FROM ab GROUP BY base) SELECT CAST(row_number() OVER (ORDER BY canonical, base <> canonical, base) - 1 AS INTEGER) AS position, base, canonical, long_name FROM u")
def alphabet_merged(spark, sf_dir):
    return alphabets.merged(_alphabets(spark, sf_dir))


COORD = WQ + ", w AS (SELECT read_id, length(seq) // 2 AS pos, substr(seq, length(seq) // 2 - 3 + 1, 7) AS fragment FROM q JOIN labels ON doc_id = read_id WHERE length(seq) // 2 >= 3 AND length(seq) // 2 + 4 <= length(seq))"


def _windows(spark, sf_dir):
    refs = sequences(spark, sf_dir)
    at = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("read_id"))
    coordinates = refs.join(at, "read_id", "left_semi").select("read_id", F.floor(F.length("seq") / 2).alias("pos"))
    return joins.coordinate_windows(coordinates, refs, 3, 4), refs


@query("coordinate_windows", COORD + " SELECT read_id, pos, fragment FROM w")
def coordinate_windows(spark, sf_dir):
    return _windows(spark, sf_dir)[0].select("read_id", "pos", "fragment")


@query("position_logodds", COORD + """, b AS (SELECT base, count(*) / sum(count(*)) OVER () AS share FROM (SELECT unnest(string_split(seq, '')) AS base FROM q WHERE seq <> '') GROUP BY base),
  p AS (SELECT k - 4 AS pos, substr(fragment, k, 1) AS base, count(*) AS n FROM w, range(1, 8) r(k) GROUP BY 1, 2)
  SELECT CAST(pos AS INTEGER) AS pos, base, n, round(ln(n / sum(n) OVER (PARTITION BY pos) / share), 6) AS logodds FROM p JOIN b USING (base)""")
def position_logodds(spark, sf_dir):
    fragments, refs = _windows(spark, sf_dir)
    return joins.position_logodds(fragments, refs, 3).select("pos", "base", "n", F.round("logodds", 6).alias("logodds"))
