"""Strand lists, reference lookups, merges, limits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from porelake.catalog import query
from porelake.operators import chunks, joins
from porelake.operators.robust import ranks
from porelake.plans._bind import Q, read, sequences
from porelake.sources import reads

REFS = f"WITH q AS ({Q})"


def _reads(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), F.col("source").alias("filename"), "n_chars")


@query("strand_list_ids", "SELECT doc_id AS read_id, source AS filename, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def strand_list_ids(spark, sf_dir):
    ids = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("read_id"))
    return joins.select_reads(_reads(spark, sf_dir), ids)


@query("strand_list_files", "SELECT doc_id AS read_id, source AS filename, n_chars FROM documents WHERE source IN ('src1', 'src4', 'src7')")
def strand_list_files(spark, sf_dir):
    names = read(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src4", "src7")).select(F.col("source").alias("filename")).distinct()
    return joins.select_reads(_reads(spark, sf_dir), names)


@query("strand_list_pairs", "SELECT d.doc_id AS read_id, d.source AS filename, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id AND d.source = 'src' || (l.doc_id % 20)")
def strand_list_pairs(spark, sf_dir):
    pairs = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("read_id"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("filename"))
    return joins.select_reads(_reads(spark, sf_dir), pairs).select("read_id", "filename", "n_chars")


@query("ref_left_join", REFS + " SELECT user_id AS read_id, count(*) AS n, CAST(coalesce(any_value(length(seq)), -1) AS INTEGER) AS reflen FROM events LEFT JOIN (SELECT * FROM q WHERE seq LIKE '%CAT%') q ON user_id = read_id GROUP BY user_id")
def ref_left_join(spark, sf_dir):
    reads = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("read_id")).agg(F.count("*").alias("n"))
    refs = sequences(spark, sf_dir).where("seq LIKE '%CAT%'").select("read_id", F.length("seq").alias("reflen"))
    return reads.join(refs, "read_id", "left").withColumn("reflen", F.coalesce("reflen", F.lit(-1)))


@query("remap_guard_counts", REFS + """, r AS (SELECT d.doc_id, length(q.seq) AS n, q.seq LIKE '%A%' AS has_ref, l.doc_id IS NOT NULL AS has_params, d.source <> 'src3' AS readable, d.source <> 'src5' AS called
  FROM documents d JOIN q ON q.read_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)
  SELECT CASE WHEN NOT has_ref THEN 'No reference found' WHEN n > 800 THEN 'Reference too long' WHEN NOT has_params THEN 'No read parameters' WHEN NOT readable THEN 'Read error' WHEN NOT called THEN 'Network error' ELSE 'Success' END AS result, count(*) AS n FROM r GROUP BY 1""")
def remap_guard_counts(spark, sf_dir):
    params = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("read_id"), F.lit(True).alias("p"))
    sources = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), "source")
    rows = sequences(spark, sf_dir).join(sources, "read_id").join(params, "read_id", "left")
    result = joins.remap_guard(F.col("seq").contains("A"), F.length("seq"), 800, F.col("p").isNotNull(), F.col("source") != "src3", F.col("source") != "src5")
    return rows.groupBy(result.alias("result")).agg(F.count("*").alias("n"))


@query("params_left_join", "SELECT e.user_id AS read_id, round(avg((value - coalesce(l.quality, 0)) / coalesce(l.toxic + 1, 2)), 6) AS z FROM events e LEFT JOIN labels l ON l.doc_id = e.user_id GROUP BY 1")
def params_left_join(spark, sf_dir):
    """Reads keep their rows without parameters of their own, and fall back to a default scaling."""
    params = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("user_id"), F.col("quality").alias("shift"), (F.col("toxic") + 1).alias("scale"))
    z = (F.col("value") - F.coalesce("shift", F.lit(0))) / F.coalesce("scale", F.lit(2))
    return read(spark, sf_dir, "events").join(params, "user_id", "left").groupBy(F.col("user_id").alias("read_id")).agg(F.round(F.avg(z), 6).alias("z"))


@query("ref_slice_pad", """WITH g AS (SELECT html, row_number() OVER (ORDER BY page_id) - 1 AS k, count(*) OVER () AS n FROM pages),
  a AS (SELECT doc_id, doc_id % (SELECT max(n) FROM g) AS k FROM documents), c AS (SELECT doc_id, html, (doc_id * 2654435761) % length(html) AS s FROM a JOIN g USING (k))
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN part ELSE reverse(part) END AS part FROM (SELECT doc_id, substr(html, greatest(0, s - 10) + 1, greatest(least(length(html), s + 50) - greatest(0, s - 10), 0)) AS part FROM c)""")
def ref_slice_pad(spark, sf_dir):
    """Alignments of 40 bases anywhere in any page, by rank of the page and a hash of the id."""
    id_, pages = F.col("doc_id"), read(spark, sf_dir, "pages").select("page_id", "html")
    ranked, n = ranks(pages, "page_id")
    at = read(spark, sf_dir, "documents").select("doc_id", (id_ % n).alias("k")).join(ranked.withColumnRenamed("rank", "k"), "k")
    s = id_ * 2654435761 % F.length("html")
    part = joins.reference_slice(F.col("html"), s, s + 40, 10)
    return at.select("doc_id", F.when(id_ % 2 == 0, part).otherwise(F.reverse(part)).alias("part"))


@query("best_alignment_per_read", "SELECT l_orderkey, l_linenumber, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1")
def best_alignment_per_read(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", F.struct("l_linenumber", "l_partkey").alias("tie"))
    return joins.best_by(li, ["l_orderkey"], "l_discount", "tie").drop("tie")


@query("fastq_alignment_join", """WITH b AS (SELECT o_orderkey, max(l_discount) AS acc FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 25 GROUP BY 1)
  SELECT o_orderkey, acc, acc IS NULL AS unaligned FROM b""")
def fastq_alignment_join(spark, sf_dir):
    best = read(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_discount").alias("acc"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(best, "o_orderkey", "left").withColumn("unaligned", F.col("acc").isNull())


@query("holdout_anti_join", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def holdout_anti_join(spark, sf_dir):
    return joins.hold_out(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), read(spark, sf_dir, "labels"), "doc_id")


@query("id_intersection", "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def id_intersection(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).intersect(read(spark, sf_dir, "orders").select("o_custkey"))


@query("id_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def id_difference(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(read(spark, sf_dir, "orders").select("o_custkey"))


@query("merge_dedup_first_wins", """WITH f AS (SELECT 0 AS file_no, o_custkey AS read_id, min(o_orderkey) AS first_order FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey
  UNION ALL SELECT 1, o_custkey, min(o_orderkey) FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey UNION ALL SELECT 2, o_custkey, min(o_orderkey) FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)
  SELECT read_id, first_order, CAST(file_no AS INTEGER) AS file_no FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY file_no) AS k FROM f) WHERE k = 1""")
def merge_dedup_first_wins(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    files = [o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("read_id")).agg(F.min("o_orderkey").alias("first_order")) for s in "FOP"]
    return joins.first_file_wins(files)


@query("merge_convert_codes", """SELECT user_id AS read_id, string_agg(CAST([2, 0, 1, 4, 3][list_position(['click','error','purchase','signup','view'], event_type)] AS VARCHAR), '' ORDER BY ts, event_id) AS codes FROM events GROUP BY user_id""")
def merge_convert_codes(spark, sf_dir):
    from porelake.plans._bind import signal

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t", "code"))), lambda x: x["code"])
    rows = signal(spark, sf_dir).groupBy("read_id").agg(ordered.alias("codes"))
    return rows.select("read_id", F.array_join(joins.convert_codes(F.col("codes"), [2, 0, 1, 4, 3]).cast("array<string>"), "").alias("codes"))


@query("split_strandlist", "SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 12 AS part FROM documents")
def split_strandlist(spark, sf_dir):
    return joins.split_list(read(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", 12, ["source"]).select("source", "doc_id", "part")


@query("first_n_reads", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def first_n_reads(spark, sf_dir):
    """The limit is the operator: the first reads by id."""
    return read(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(100)


@query("sample_with_replacement", """WITH d AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents),
  a AS (SELECT id AS attempt, (((((id * 1103515245 + 12345 + 11) % 2147483648) * 1103515245 + 12345) % 2147483648) // 65536) % (SELECT max(n) FROM d) AS pick FROM range((SELECT count(*) FROM documents)) t(id))
  SELECT attempt, doc_id FROM a JOIN d ON d.k = a.pick WHERE n_chars >= 100""")
def sample_with_replacement(spark, sf_dir):
    """As many draws as there are reads; those of reads long enough are accepted."""
    numbered, n = ranks(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return chunks.sample_attempts(n, n, 1.0, 11, spark).join(numbered.withColumnRenamed("rank", "pick"), "pick").where("n_chars >= 100").select("attempt", "doc_id")


@query("sample_without_replacement", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)) LIMIT 64")
def sample_without_replacement(spark, sf_dir):
    """The limit is the operator: a fixed number of reads in a hash's order."""
    return read(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string"))).limit(64)


@query("chunk_idx_join", "SELECT vec_id AS chunk_idx, len(embedding) AS n_samples, length(text) AS reflen FROM embeddings JOIN documents ON doc_id = vec_id")
def chunk_idx_join(spark, sf_dir):
    c = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_idx"), F.size("embedding").cast("long").alias("n_samples"))
    return c.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_idx"), F.length("text").cast("long").alias("reflen")), "chunk_idx")


LIMITED = """WITH f AS (SELECT o_orderstatus AS status, o_custkey AS read_id, min(o_orderkey) AS first_order, md5(o_custkey || ':3') AS h FROM orders GROUP BY 1, 2),
  a AS (SELECT * FROM f WHERE status = 'F' ORDER BY h LIMIT 40), b AS (SELECT * FROM f WHERE status = 'O' AND read_id NOT IN (SELECT read_id FROM a) ORDER BY h LIMIT 40),
  c AS (SELECT * FROM f WHERE status = 'P' AND read_id NOT IN (SELECT read_id FROM a UNION SELECT read_id FROM b) ORDER BY h LIMIT 40)
  SELECT read_id, first_order, 0 AS file_no FROM a UNION ALL SELECT read_id, first_order, 1 FROM b UNION ALL SELECT read_id, first_order, 2 FROM c"""


@query("merge_limit_shuffled", LIMITED)
def merge_limit_shuffled(spark, sf_dir):
    """The limit is the operator: so many new reads of each file, in a hash's order."""
    o = read(spark, sf_dir, "orders")
    files = [o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("read_id")).agg(F.min("o_orderkey").alias("first_order")) for s in "FOP"]
    return joins.first_file_wins(files, limit=40, seed=3)


MIX = "(((({0}) * 1103515245 + 12345 + {1}) % 2147483648) * 1103515245 + 12345) % 2147483648 // 65536"


@query("random_batches", f"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents), n AS (SELECT max(n) AS n FROM d),
  b AS (SELECT id AS batch, ({MIX.format('id', 5)} % 2001 + 1000) // 5 * 5 AS chunk_len FROM range((SELECT n // 20 FROM n)) t(id)),
  z AS (SELECT *, CAST(floor(4.0::DOUBLE * 3000 / chunk_len + 0.5::DOUBLE) AS BIGINT) AS size FROM b),
  s AS (SELECT batch, chunk_len, unnest(range(size)) AS slot FROM z)
  SELECT batch, chunk_len, slot, doc_id FROM (SELECT *, {MIX.format('batch * 64 + slot', 6)} % (SELECT n FROM n) AS k FROM s) JOIN d USING (k)""")
def random_batches(spark, sf_dir):
    """Batches of chunks of a random length, a multiple of the stride; shorter chunks make more."""
    numbered, n = ranks(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    drawn = chunks.random_batches(spark, n // 20, n, shortest=1000, longest=3000, stride=5, least=4, seed=5)
    return drawn.join(numbered.withColumnRenamed("rank", "pick"), "pick").select("batch", "chunk_len", "slot", "doc_id")


@query("read_metadata", "SELECT user_id AS read_id, arg_max(value, 'Read_' || event_id) AS value, arg_max(event_type, 'Read_' || event_id) AS event_type, max('Read_' || event_id) AS read_group FROM events GROUP BY 1")
def read_metadata(spark, sf_dir):
    """Attributes of a read from the last of its groups, in the order of their names."""
    from porelake.sources.reads import last_group

    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("read_id"), F.concat(F.lit("Read_"), F.col("event_id").cast("string")).alias("read_group"), "value", "event_type")
    return last_group(e, ["value", "event_type"])


@query("strand_list_files_exact", "SELECT (row_number() OVER (ORDER BY filename) - 1) // 70 AS file, row_number() OVER (ORDER BY filename) - 1 AS place, filename FROM (SELECT url || '/' || page_id AS filename FROM pages)")
def strand_list_files_exact(spark, sf_dir):
    """Which list of 70 names each page's file belongs to; names are ordered over all of them."""
    names = read(spark, sf_dir, "pages").select(F.concat(F.col("url"), F.lit("/"), F.col("page_id").cast("string")).alias("filename"))
    return reads.listed(names, 70, buckets=16)


@query("differing_keys", """WITH r AS (SELECT doc_id, list_sort(list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, 'text'], lambda k: k IS NOT NULL)) AS keys
    FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT keys, count(*) AS n, list(CAST(doc_id AS VARCHAR) ORDER BY CAST(doc_id AS VARCHAR))[1:3] AS examples FROM r GROUP BY keys)
  SELECT array_to_string(keys, ',') AS keys, n, array_to_string(examples, ',') AS examples, CASE WHEN count(*) OVER () > 1 THEN 'reads of one table have different keys' END AS warning FROM n""")
def differing_keys(spark, sf_dir):
    """Documents as reads whose labels are optional keys."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 1).alias("quality"), F.when(F.col("toxic") == 1, 1).alias("toxic"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("text")).join(labels, "doc_id", "left")
    return reads.differing_keys(rows, "doc_id", 3).select(F.array_join("keys", ",").alias("keys"), "n", F.array_join("examples", ",").alias("examples"), "warning")
