"""Alphabets with modified bases, one row a base: (file, position, base, canonical, long_name).

A base is canonical if it is its own canonical base; long names belong to modified ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def is_mod() -> Column:
    return F.col("base") != F.col("canonical")


def labels(alphabets: DataFrame, by: str = "file") -> DataFrame:
    """Adds what follows from the order of an alphabet: ``collapse_label`` (position of the canonical
    base), ``can_label`` (its number among canonical ones), ``mod_label`` (0 for a canonical base, else
    its number among the modifications of its base), ``n_mods`` of the canonical base, and ``offset``:
    where the base's entries begin in an output layer grouped by canonical base."""
    own = Window.partitionBy(by)
    first = F.when(~is_mod(), F.col("position"))
    rows = alphabets.withColumn("collapse_label", F.min(first).over(Window.partitionBy(by, "canonical")))
    rows = rows.withColumn("can_label", F.dense_rank().over(own.orderBy("collapse_label")) - 1)
    in_group = Window.partitionBy(by, "canonical")
    rows = rows.withColumn("mod_label", F.when(is_mod(), F.count_if(is_mod()).over(in_group.orderBy("position"))).otherwise(0))
    rows = rows.withColumn("n_mods", F.count_if(is_mod()).over(in_group))
    before = F.sum(F.when(~is_mod(), F.col("n_mods") + 1).otherwise(0)).over(own.orderBy("collapse_label").rangeBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("offset", F.coalesce(before, F.lit(0)))


def faults(alphabets: DataFrame, by: str = "file") -> DataFrame:
    """(file, message) of alphabets that are not sound."""
    found = alphabets.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("base").alias("bases"), F.collect_set("canonical").alias("canonical"), F.collect_set("base").alias("all"), F.count_if(is_mod() & F.col("long_name").isNull()).alias("nameless"))
    said = F.when(F.col("n") != F.col("bases"), "a base occurs twice").when(F.size(F.array_except("canonical", "all")) > 0, "a canonical base is not in the alphabet").when(F.col("nameless") > 0, "a modified base has no long name")
    return found.select(by, said.alias("message")).where("message IS NOT NULL")


def renamed(alphabets: DataFrame, renames: DataFrame) -> DataFrame:
    """Alphabets with bases and long names changed. renames: (kind, old, new), kind being 'canonical',
    'modified' or 'long_name'; a canonical base is changed for its modifications too."""
    out = alphabets
    was_mod = alphabets.withColumn("_mod", is_mod())
    of = lambda kind, name: F.broadcast(renames.where(F.col("kind") == kind).select(F.col("old").alias(f"_{name}_old"), F.col("new").alias(f"_{name}_new")))  # noqa: E731  an alphabet's few renames
    out = was_mod.join(of("canonical", "can"), F.col("canonical") == F.col("_can_old"), "left").join(of("modified", "mod"), F.col("_mod") & (F.col("base") == F.col("_mod_old")), "left").join(of("long_name", "name"), F.col("long_name") == F.col("_name_old"), "left")
    canonical = F.coalesce("_can_new", "canonical")
    base = F.when(F.col("_mod"), F.coalesce("_mod_new", "base")).otherwise(canonical)
    new = {"base": base, "canonical": canonical, "long_name": F.coalesce("_name_new", "long_name")}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in alphabets.columns])


def all_equal(alphabets: DataFrame, by: str = "file") -> DataFrame:
    """(n_files, n_alphabets, equal): files may be joined as they are if their alphabets are equal."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("position", "base", "canonical", "long_name"))), lambda r: F.concat_ws("=", r["base"], r["canonical"], r["long_name"]))
    one = alphabets.groupBy(by).agg(F.array_join(rows, ",").alias("spelled"))
    return one.agg(F.count("*").alias("n_files"), F.countDistinct("spelled").alias("n_alphabets")).withColumn("equal", F.col("n_alphabets") <= 1)


def conflicts(alphabets: DataFrame) -> DataFrame:
    """(rule, what, n) of modified bases that keep alphabets from being merged: a base with several
    canonical bases, a base with several long names, a long name of several bases."""
    mods = alphabets.where(is_mod())
    rules = (("canonical bases of a modified base", "base", "canonical"), ("long names of a modified base", "base", "long_name"), ("modified bases of a long name", "long_name", "base"))
    found = [mods.groupBy(F.col(key).alias("what")).agg(F.countDistinct(value).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "what", "n") for rule, key, value in rules]
    return found[0].unionByName(found[1]).unionByName(found[2])


def merged(alphabets: DataFrame) -> DataFrame:
    """(position, base, canonical, long_name): the union of all files' bases, each canonical base
    followed by its modifications. Call ``conflicts`` first."""
    rows = alphabets.groupBy("base").agg(F.min("canonical").alias("canonical"), F.min("long_name").alias("long_name"))
    order = Window.orderBy("canonical", is_mod().cast("int"), "base")  # an alphabet is a few rows
    return rows.withColumn("position", F.row_number().over(order) - 1).select("position", "base", "canonical", "long_name")


def mod_conflicts(mods: DataFrame) -> DataFrame:
    """(mod, n_canonical, n_names, conflict): the first two rules for every modified base."""
    return mods.groupBy("mod").agg(F.countDistinct("canonical").alias("n_canonical"), F.countDistinct("long_name").alias("n_names")).withColumn("conflict", (F.col("n_canonical") > 1) | (F.col("n_names") > 1))


def sort_alphabet(mods: DataFrame) -> DataFrame:
    """Rows of an alphabet by canonical base, then code."""
    return mods.withColumn("position", F.row_number().over(Window.orderBy("canonical", "code")) - 1)  # an alphabet is a few rows
