"""Typo-tolerant name joins and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex.functions.text import core_name, grade, key_core, key_core_whole, osa


def _cuts(name: Column) -> Column:
    """What one deletion makes of the name, each once."""
    cut = lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name)))
    return F.when(F.length(name) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), cut))).otherwise(F.array().cast("array<string>"))


def _keyed(names: DataFrame, name: str, out: str, left: bool) -> DataFrame:
    """(kind, k, name): two different names share one key if they are within one edit or swap, else none; equal ones share
    one of kind 0, and others. Kind i > 0: all signs but sign i; kind -i: signs i and i + 1, which differ, in order; kind 0:
    the name, and on the left what a deletion leaves; ``_OTHER``: the name on the left, what a deletion leaves on the right."""
    spark = names.sparkSession
    # a number of parts of its own: names are small, and what they become is not
    one = names.where(F.col(name).isNotNull()).select(F.col(name).alias(out)).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), out)
    key = lambda kind, k: F.struct(kind.cast("int").alias("kind"), k.alias("k"))
    own, cuts = F.array(F.col(out)), _cuts(F.col(out))
    same, other = (F.concat(own, cuts), own) if left else (own, cuts)
    dealt = [one.select(F.lit(0).alias("kind"), F.explode(same).alias("k"), out), one.select(F.lit(_OTHER).alias("kind"), F.explode(other).alias("k"), out)]
    i = F.col("_i")
    head, tail = F.substring(out, F.lit(1), i - 1), lambda n: F.substring(F.col(out), i + n, F.length(out))
    x, y = F.substring(out, i, F.lit(1)), F.substring(out, i + 1, F.lit(1))
    placed = one.where(F.length(out) > 0).select(out, F.explode(F.sequence(F.lit(1), F.length(out))).alias("_i"))
    keys = F.array(key(i, F.concat(head, tail(1))), F.when((y != "") & (x != y), key(-i, F.concat(head, F.least(x, y), F.greatest(x, y), tail(2)))))
    changed = placed.select(out, F.explode(keys).alias("_k")).where("_k IS NOT NULL").select("_k.kind", "_k.k", out)
    return dealt[0].union(dealt[1]).union(changed)


#: The kind of keys by which names of the right side lose a sign.
_OTHER = -1_000_000_000


def close_pairs(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """(a, b): distinct names of either side within OSA distance 1. A pair is met once, on what the two have in common, so
    the join makes little more than the result and nothing is tested or told apart afterwards."""
    a, b = _keyed(left, name, "a", True), _keyed(right, name, "b", False)
    # sizes are estimated from the names, so a side that looks small enough for a broadcast may not be
    return a.hint("merge").join(b, ["kind", "k"]).where("kind = 0 OR a <> b").select("a", "b")


def without_close(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Rows of ``left`` whose name is within distance 1 of no name of ``right``."""
    near = close_pairs(left, right, name).select(F.col("a").alias(name)).distinct()
    return left.join(near, name, "left_anti")


def search(names: DataFrame, name: str, query: str, limit: int = 60, distance=F.levenshtein) -> DataFrame:
    """The ``limit`` nearest distinct names with their grade; queries under two characters find nothing."""
    if len(query) < 2:
        return names.select(F.col(name).alias("name"), F.lit(0).alias("distance"), F.lit("").alias("grade")).where(F.lit(False))
    found = names.select(F.col(name).alias("name")).distinct().withColumn("distance", distance(F.col("name"), F.lit(query)))
    return found.orderBy("distance", F.length("name"), "name").limit(limit).withColumn("grade", grade(F.col("distance")))


def street_keys(names: DataFrame, name: str, ordinal: str) -> DataFrame:
    """(name, first, keys): each distinct name with its first ordinal and its keys without and with its prefix, each once,
    empty ones left out."""
    once = names.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(ordinal).alias("first"))
    both = once.withColumn("core", key_core(F.col("name"))).withColumn("whole", key_core_whole(F.col("name")))
    return both.select("name", "first", F.filter(F.array_distinct(F.array("core", "whole")), lambda k: k != "").alias("keys"))


def search_keys(keyed: DataFrame, query: str, limit: int = 60) -> DataFrame:
    """(name, distance, grade, keys): the ``limit`` nearest of ``street_keys`` by the better of their keys, then by the length
    of the keys, then by first place. The query keeps its prefix; a key of under two characters finds nothing."""
    wanted = core_name(query, strip=False)
    if len(wanted) < 2:
        return keyed.select("name", F.lit(0).alias("distance"), F.lit("").alias("grade"), "keys").where(F.lit(False))
    far = F.lit(2_000_000_000)
    each = [F.coalesce(osa(F.get("keys", F.lit(i)), F.lit(wanted)), far) for i in range(2)]
    found = keyed.where(F.size("keys") > 0).withColumn("distance", F.least(*each))
    return found.orderBy("distance", F.length(F.array_join("keys", ",")), "first").limit(limit).select("name", "distance", grade(F.col("distance")).alias("grade"), "keys")
