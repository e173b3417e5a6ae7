"""Joins of rows with what is known of their groups, where one group may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex.staging import stage

#: A group with more than 1 / HUBS of all rows is a hub, if it has more than HUB_ROWS; there are fewer than HUBS of them.
HUBS = 256
HUB_ROWS = 100
#: A value with more than 1 / COMMON of all rows is common; there are fewer than COMMON of them.
COMMON = 1 << 18
#: Keys that go to every task at most where rows are chosen by them.
HELD = 1 << 21


def with_groups(rows: DataFrame, keys: list[str], aggregates: list[Column], condition: str | None = None, hubs: int = HUBS) -> DataFrame:
    """Each row with its group's aggregates, but for groups that fail ``condition`` (SQL over them and ``_rows``).

    Groups are combined before the shuffle and staged. Rows of hubs meet their group by broadcast and are never
    gathered in one task; the others meet theirs by a shuffle on the keys. Rows with a null key are left out.
    ``rows`` is read up to three times, so it should be a staged table or cheap to make from one.
    """
    found = stage(rows.groupBy(*keys).agg(*aggregates, F.count("*").alias("_rows")), "groups")
    total, top = found.agg(F.sum("_rows"), F.max("_rows")).first()
    least = max(HUB_ROWS, (total or 0) // hubs)
    kept = (found.where(condition) if condition else found).select("*", (F.col("_rows") > least).alias("_hub")).drop("_rows")
    if (top or 0) <= least:
        return rows.join(kept.drop("_hub"), keys)
    # fewer than ``hubs`` rows are broadcast
    often = F.broadcast(found.where(F.col("_rows") > least).select(*keys))
    rest = rows.join(often, keys, "left_anti").join(kept.where("NOT _hub").drop("_hub"), keys)
    return rows.join(F.broadcast(kept.where("_hub").drop("_hub")), keys).unionByName(rest)


def hub_keys(rows: DataFrame, key: str, hubs: int = HUBS) -> DataFrame | None:
    """The keys, fewer than ``hubs``, that hold more than 1 / ``hubs`` of all rows each, staged; None if there are none."""
    least = max(HUB_ROWS, rows.count() // hubs)
    found = stage(rows.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > least).select(key), "hubs")
    return None if found.isEmpty() else found


def looked_up(rows: DataFrame, table: DataFrame, key: str, often: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined to the one row of ``table`` that has their key (``how``: inner or left); those of the keys ``often``
    meet it by broadcast."""
    if often is None:
        return rows.join(table, key, how)
    near = table.join(F.broadcast(often), key, "left_semi")  # fewer than HUBS rows
    hot = rows.join(F.broadcast(often), key, "left_semi").join(F.broadcast(near), key, how)
    return hot.unionByName(rows.join(F.broadcast(often), key, "left_anti").join(table, key, how))


def with_keys(rows: DataFrame, keys: DataFrame, key: str, held: int = HELD) -> DataFrame:
    """The rows whose key is among ``keys`` (copies allowed): up to ``held`` keys go to the rows, so that wide rows stay
    where they are; more meet them by a shuffle, unless Spark finds them small."""
    told = stage(keys.select(key).distinct(), "keys")
    return rows.join(F.broadcast(told) if told.count() <= held else told, key, "left_semi")


def found_in(rows: DataFrame, group: str, value: str, members: DataFrame, common: int = COMMON) -> DataFrame:
    """(group, tokens, hits) of each group: its rows, and those whose value is one of ``members`` (one column, copies
    allowed). A null value is none.

    Values are counted, combined before the shuffle. Common ones go to the rows by broadcast with what they are, so their
    rows aren't shuffled; rows of the others are shuffled once and come back as counts. ``rows`` is read up to three times.
    """
    each = rows.select(F.col(value), F.lit(1).alias("_rows"), F.lit(0).alias("_in"))
    each = each.union(members.select(F.col(members.columns[0]), F.lit(0), F.lit(1))).where(F.col(value).isNotNull())
    values = stage(each.groupBy(value).agg(F.sum("_rows").alias("_rows"), F.max("_in").alias("_in")).where("_rows > 0"), "values")
    least = (values.agg(F.sum("_rows")).first()[0] or 0) // common
    near = values.where(F.col("_rows") > least).select(value, "_in")
    met = rows.join(F.broadcast(near), value, "left").select(group, F.lit(1).alias("tokens"), F.coalesce("_in", F.lit(0)).alias("hits"))
    if least:
        rare = values.where((F.col("_rows") <= least) & (F.col("_in") == 1)).select(value)
        far = rows.join(F.broadcast(near.select(value)), value, "left_anti").join(rare, value)
        met = met.union(far.select(group, F.lit(0), F.lit(1)))
    return met.groupBy(group).agg(F.sum("tokens").alias("tokens"), F.sum("hits").alias("hits"))
