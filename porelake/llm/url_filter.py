"""Operator 13: url filters by rules, and by a Bloom filter cascade for what no rule decides.

The cascade holds a list of hosts within the universe of all hosts of the table. Its first level is a
Bloom filter of the listed hosts; the second one encodes the unlisted hosts that pass the first, the
third the listed ones that pass the second, and so on until a level lets none through wrongly. A host
is listed when the first level that it fails is an even one, or when it passes all and their number is
odd: exact for every host of the universe. Hosts are dealt over shards by their hash, so that a
shard's filters stay small however many hosts are listed. All filters together become one array that
expressions index, so no row is joined; beyond ``most_bytes`` rows meet their shard's filters by a
join on the shard instead, which gives the same verdicts (a hot shard is split by Spark's skew join).

A rule fits its host and all subdomains, for paths that start with its own. The longest rule (host and
path together) wins, of equally long ones the one with the longer host, then the first.

Defined results: a null url and one without ``://`` have an empty host and path, which no rule fits and
no list holds, so they are allowed. A repeated page keeps its rows. Ports and user names stay part
of the host. Only A-Z are lower-cased. Urls of any length are taken whole. An empty table, and an
empty list, are fine: with nothing listed the method allows. Further columns are ignored, whatever
their names. Everything is a Spark expression or aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from porelake.llm._shared import materialize, table

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
# Names of spam sites; a host with such a label is listed.
SPAM_LABELS = ("spam-farm", "cheap-pills", "free-bets")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = 64  # bits of an array element


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    order = sorted(range(len(rules)), key=lambda k: (len(rules[k][1]) + len(rules[k][2]), len(rules[k][1]), -k))
    for action, h, p in (rules[k] for k in order):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("verdict"))).otherwise(found)
    return found


def _bit(key: Column, level: int, k: int, bits: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.lit(k), key), bits)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards)).cast("int")


def _passes(words: Column, bits: Column, key: Column, level: int, hashes: int) -> Column:
    """Whether all of the key's bits are set; in no words at all none is."""
    def is_set(k: int) -> Column:
        at = _bit(key, level, k, bits)
        return F.getbit(F.get(words, (at / WORD).cast("int")), F.pmod(at, F.lit(WORD)).cast("int")) == 1

    return (bits > 0) & F.coalesce(reduce(lambda a, b: a & b, [is_set(k) for k in range(hashes)]), F.lit(False))


def _filters(keys: DataFrame, level: int, hashes: int, bits_a_key: int) -> DataFrame:
    """(shard, bits, words) of the (shard, key) rows: one Bloom filter for each shard that has keys."""
    sizes = keys.groupBy("shard").agg(F.count("*").alias("n")).select("shard", (F.ceil(F.col("n") * bits_a_key / WORD) * WORD).cast("long").alias("bits"))
    at = keys.join(sizes, "shard").select("shard", "bits", F.explode(F.array(*[_bit(F.col("key"), level, k, F.col("bits")) for k in range(hashes)])).alias("at"))
    # bits meet in their words first, so what a shard gathers is its filter and no longer its keys
    words = at.groupBy("shard", "bits", F.floor(F.col("at") / WORD).cast("int").alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(WORD)).cast("int"))).alias("w"))
    there = words.groupBy("shard", "bits").agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), (F.col("bits") / WORD).cast("int") - 1), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0).cast("long")))
    return there.select("shard", "bits", full.alias("words"))


class Cascade:
    """The written levels of a cascade; ``listed`` tells exactly for keys of the universe."""

    def __init__(self, levels: list[DataFrame], shards: int, hashes: list[int], n_bytes: int):
        self.levels, self.shards, self.hashes, self.n_bytes = levels, shards, hashes, n_bytes

    def _verdict(self, key: Column, level: list[tuple[Column, Column]]) -> Column:
        found = F.lit(len(level) % 2 == 1)
        for i in range(len(level) - 1, -1, -1):
            found = F.when(_passes(*level[i], key, i + 1, self.hashes[i]), found).otherwise(F.lit(i % 2 == 1))
        return found

    def mark(self, rows: DataFrame, key: str, name: str, most_bytes: int) -> DataFrame:
        """The rows with a Boolean column: whether the key is listed."""
        if not self.levels:
            return rows.withColumn(name, F.lit(False))
        shard = _shard(F.col(key), self.shards)
        if self.n_bytes <= most_bytes:  # one literal: an array of shards for each level, at most most_bytes in all
            level = []
            for df in self.levels:
                held = {r.shard: (r.bits, r.words) for r in df.collect()}
                of = F.array(*[F.lit(held.get(s, (0, []))[0]).cast("long") for s in range(self.shards)])
                words = F.array(*[F.lit(held[s][1]).cast("array<long>") if s in held else F.array().cast("array<long>") for s in range(self.shards)])
                level.append((F.get(words, shard), F.get(of, shard)))
            return rows.withColumn(name, self._verdict(F.col(key), level))
        own, at, kept = "_" + "_".join(rows.columns), [], rows.columns  # no column of the rows has this name
        all_levels = None
        for i, df in enumerate(self.levels):
            df = df.select(F.col("shard").alias(own), F.struct("words", "bits").alias(f"{own}{i}"))
            all_levels = df if all_levels is None else all_levels.join(df, own, "left")  # level 1 has every shard that a later one has
            at.append((F.col(f"`{own}{i}`.words"), F.coalesce(F.col(f"`{own}{i}`.bits"), F.lit(0).cast("long"))))
        met = rows.withColumn(own, shard).join(all_levels, own, "left")
        return met.select(*[F.col(f"`{c}`") for c in kept], self._verdict(F.col(key), at).alias(name))


def cascade(universe: DataFrame, shard_keys: int = 65_536, bits_a_key: int = 8, most_levels: int = 64) -> Cascade:
    """The cascade of a table (key, listed) that holds every key once. The first level spends
    ``bits_a_key`` bits on a listed key, later ones two; levels shrink by a steady factor."""
    n_listed = universe.where("listed").count()
    shards = max(1, -(-n_listed // shard_keys))
    keys = materialize(universe.select("key", "listed", _shard(F.col("key"), shards).alias("shard")), "cascade-keys")
    wanted, others = keys.where("listed"), keys.where("NOT listed")
    levels, hashes, n_bytes = [], [], 0
    for level in range(1, most_levels + 1):
        if wanted.isEmpty():
            return Cascade(levels, shards, hashes, n_bytes)
        a_key, k = (bits_a_key, 4) if level == 1 else (2, 1)
        made = materialize(_filters(wanted, level, k, a_key), "cascade-level")
        levels.append(made)
        hashes.append(k)
        n_bytes += int(made.agg(F.sum("bits")).first()[0]) // 8
        through = others.join(made, "shard").where(_passes(F.col("words"), F.col("bits"), F.col("key"), level, k))
        wanted, others = materialize(through.select("key", "listed", "shard"), "cascade-through"), wanted
    raise RuntimeError("the cascade did not end")


def judged(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, most_bytes: int = 2 << 20, shard_keys: int = 65_536) -> DataFrame:
    """(page_id, host, path, rule, verdict). Without a rule the verdict is block for hosts of
    ``listed`` (column host), by default those that ``listed_hosts`` finds in the pages."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules))
    hosts = rows.groupBy(F.col("host").alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col("found.verdict") == "block").alias("n_blocked"))
    if listed is None:
        universe = hosts.select("key", listed_host(F.col("key"), F.col("n"), F.col("n_blocked")).alias("listed"))
    else:
        known = listed.select(F.col("host").cast("string").alias("key"), F.lit(True).alias("listed")).where("key != ''").distinct()
        universe = hosts.join(known, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    marked = cascade(materialize(universe, "cascade-universe"), shard_keys).mark(rows, "host", "listed", most_bytes)
    by_method = F.when(F.col("listed"), "block").otherwise("allow")
    return marked.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_method).alias("verdict"))


def listed_host(host: Column, n: Column, n_blocked: Column, labels=SPAM_LABELS) -> Column:
    """A host is listed if a label of it is a spam site's name, or if rules block over half of its pages."""
    return (host != "") & (F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, labels))) | (2 * n_blocked > n))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


ORACLE_SQL = f"""
WITH r AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), rules AS (
  SELECT * FROM (VALUES {", ".join(f"('{a}', '{h}', '{p}', {len(h + p)})" for a, h, p in RULES)}) t(action, h, pre, len)
), m AS (
  SELECT page_id, p.host, p.path, arg_max(h || pre, len) AS rule, arg_max(action, len) AS verdict
  FROM p LEFT JOIN rules ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, pre)
  GROUP BY page_id, p.host, p.path
), hosts AS (
  SELECT host, host <> '' AND (list_has_any(string_split(host, '.'), {list(SPAM_LABELS)}) OR 2 * count(*) FILTER (verdict = 'block') > count(*)) AS listed
  FROM m GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM m JOIN hosts USING (host)
"""
