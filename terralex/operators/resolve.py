"""Choosing one text among sources by priority, with a confidence, and scoring sources against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.functions.text import content_words
from terralex.staging import stage


def first_value(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """The first value of each key by an explicit ordinal; an empty key names nothing."""
    return df.where(F.col(key) != "").groupBy(key).agg(F.min_by(value, ordinal).alias(value))


def chosen(sources: list[tuple[str, Column]], enough: int = 80) -> tuple[Column, Column]:
    """(source, text): the first source in order with a long enough text, else the longest, the first on ties."""
    size = lambda t: F.coalesce(F.length(t), F.lit(0))
    longest = F.greatest(*[size(t) for _, t in sources])
    pick = lambda value: F.coalesce(
        *[F.when(size(t) >= enough, value(n, t)) for n, t in sources],
        *[F.when((size(t) == longest) & (longest > 0), value(n, t)) for n, t in sources],
    )
    return pick(lambda n, t: F.lit(n)), pick(lambda n, t: t)


def overlap(base: Column, other: Column) -> Column:
    """Share of the base's content words that the other has."""
    a, b = content_words(F.coalesce(base, F.lit(""))), content_words(F.coalesce(other, F.lit("")))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a))


def confidence(source: Column, text: Column, sources: list[tuple[str, Column]], weak: str) -> Column:
    """High for any source but ``weak``; a lone weak one is low unless another source shares half its words."""
    backed = [F.when((source != n) & t.isNotNull(), overlap(text, t) >= 0.5).otherwise(F.lit(False)) for n, t in sources]
    any_backs = backed[0]
    for b in backed[1:]:
        any_backs = any_backs | b
    return F.when(source.isNull(), "none").when(source != weak, "high").when(any_backs, "high").otherwise("low")


def upper_median(values: Column) -> Column:
    """The element at n div 2 of the sorted values: no interpolation."""
    held = F.array_sort(F.collect_list(values))
    return F.element_at(held, (F.floor(F.size(held) / 2) + 1).cast("int"))


def upper_medians(df: DataFrame, group: str, value: str, name: str = "upper_median") -> DataFrame:
    """(group, name): ``upper_median`` of each group's values, for groups of any size.

    Equal values are counted first. Ranges of (group, value) are counted next, and only the range that holds a group's
    middle is ordered, so no task gathers a group. Null values don't count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.struct(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranged = stage(counts.repartitionByRange("g", "v").withColumn("range", F.spark_partition_id()), "median-ranges")
    own = Window.partitionBy("g")
    sizes = ranged.groupBy("g", "range").agg(F.sum("n").alias("m"))  # a row per group and range
    upto = F.sum("m").over(own.orderBy("range"))
    middle = sizes.select("g", "range", (upto - F.col("m")).alias("before"), upto.alias("upto"), F.floor(F.sum("m").over(own) / 2).alias("at")).where("before <= at AND at < upto")
    inside = ranged.join(middle, ["g", "range"]).withColumn("seen", F.col("before") + F.sum("n").over(Window.partitionBy("g", "range").orderBy("v")))
    return inside.where("seen > at").groupBy("g").agg(F.min("v").alias(name)).select(f"g.{group}", name)
