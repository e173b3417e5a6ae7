"""Ordered logic as windows: runs, first and last writers, splices, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive(df: DataFrame, group: str, order: list[str], *columns: str) -> DataFrame:
    """Each row with the next row's columns under next_<name>; the last of a group is left out."""
    w = Window.partitionBy(group).orderBy(*order)
    out = df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns], F.lead(F.lit(1)).over(w).alias("_more"))
    return out.where("_more = 1").drop("_more")


def collapsed(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Without rows that repeat the value before them."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(group).orderBy(*order)) == 1
    marked = df.withColumn("_keep", first | ~F.col(value).eqNullSafe(before))
    return marked.where("_keep").drop("_keep")


def longest_run(df: DataFrame, group: str, order: list[str], holds: Column) -> DataFrame:
    """(group, run_start, run_length) of the longest run of rows for which ``holds``; the first on ties, positions from 1."""
    w = Window.partitionBy(group).orderBy(*order)
    numbered = df.withColumn("_pos", F.row_number().over(w)).where(holds)
    islands = numbered.withColumn("_island", F.col("_pos") - F.row_number().over(w))
    runs = islands.groupBy(group, "_island").agg(F.min("_pos").alias("run_start"), F.count("*").alias("run_length"))
    best = runs.groupBy(group).agg(F.min_by(F.struct("run_start", "run_length"), F.struct(-F.col("run_length"), "run_start")).alias("r"))
    return best.select(group, F.col("r.run_start").alias("run_start"), F.col("r.run_length").alias("run_length"))


def without_weak_head(df: DataFrame, group: str, order: list[str], strong: Column, most: int = 3) -> DataFrame:
    """Without up to ``most`` leading rows before the first strong one."""
    w = Window.partitionBy(group).orderBy(*order)
    seen = F.max(strong.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("__seen", seen).withColumn("__pos", F.row_number().over(w))
    return marked.where("__seen = 1 OR __pos > %d" % most).drop("__seen", "__pos")


def splice_points(df: DataFrame, group: str, order: list[str], length: str, at: Column) -> DataFrame:
    """First row of each group at which the running length reaches ``at``, with the length before it."""
    w = Window.partitionBy(group).orderBy(*order)
    running = df.withColumn("reached", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_pos", F.row_number().over(w)).withColumn("_at", at)
    hit = running.where(F.col("reached") >= F.col("_at")).groupBy(group).agg(F.min_by(F.struct("_pos", "reached", length), "_pos").alias("s"))
    return hit.select(group, F.col("s._pos").alias("splice_pos"), (F.col("s.reached") - F.col(f"s.{length}")).alias("before"), F.col("s.reached").alias("reached"))


def first_writers(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def last_states(df: DataFrame, keys: list[str], order: list[str], *columns: str) -> DataFrame:
    """The latest value of the columns for each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("s")).select(*keys, *[F.col(f"s.{c}").alias(c) for c in columns])


def queue_order(df: DataFrame, keys: list[str], seq: str, value: str, keep: int) -> DataFrame:
    """A keyed queue: a key keeps its first place and its last value; the last ``keep`` places stay."""
    held = df.groupBy(*keys).agg(F.min(seq).alias("first_seq"), F.max_by(value, seq).alias(value))
    return held.orderBy(F.desc("first_seq")).limit(keep)


def page_after(df: DataFrame, key: str, after, size: int = 500) -> DataFrame:
    """One keyset page; an empty page ends the scan."""
    left = df if after is None else df.where(F.col(key) > F.lit(after))
    return left.orderBy(key).limit(size)
