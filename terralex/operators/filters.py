"""Row predicates for roads, names and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex.functions import fixed, text
from terralex.operators.fuzzy import without_close


def named(name: Column) -> Column:
    return name.isNotNull() & (F.trim(name) != "")


def excluded(kind: Column, kinds: list[str]) -> Column:
    """True where the kind is none of ``kinds``; a missing kind passes."""
    return ~F.coalesce(kind, F.lit("")).isin(*kinds)


def base_road(name: Column, footway: Column) -> Column:
    """Named, no pavement piece, no numbered lane, no car park."""
    pavement = excluded(footway, ["sidewalk", "crossing", "traffic_island", "link"])
    lane = name.startswith("Voie ") & name.contains("/")
    return named(name) & pavement & ~lane & ~F.lower(name).contains("parking")


def without_codes(name: Column) -> Column:
    """Names without internal codes such as M/18."""
    return named(name) & ~name.rlike(r"(?U)\b\w{1,3}/\d+\b")


def precedence(*names: Column) -> Column:
    """First that isn't null; an empty name still counts here."""
    return F.coalesce(*names)


def constraint(room: Column, key: Column, name: Column, lat: Column, lon: Column, by: Column, color: Column) -> Column:
    """The checks of a discovery row: sizes, ranges, a colour; missing ``by`` and ``color`` pass."""
    sized = lambda c, n: c.isNotNull() & F.length(c).between(1, n)
    ranged = lambda c, n: c.isNotNull() & c.between(-n, n)
    return F.coalesce(
        sized(room, 12) & sized(key, 200) & sized(name, 120) & ranged(lat, 90) & ranged(lon, 180)
        & (by.isNull() | (F.length(by) <= 64)) & (color.isNull() | color.rlike("^#[0-9a-fA-F]{6}$")),
        F.lit(False),
    )


def room_code(text: Column) -> Column:
    """The code in upper case, or null if it is none."""
    code = F.upper(F.trim(text))
    return F.when(code.rlike("^[A-Z0-9]{1,12}$"), code)


def quarantined(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that don't)."""
    return df.where(valid), df.where(~valid)


def existing(paths: DataFrame, nodes: DataFrame, path: str, pos: str, node: str) -> DataFrame:
    """(path, nodes): the nodes of each path that exist, in order."""
    held = paths.join(nodes.select(node).distinct(), node, "left_semi")
    return held.groupBy(path).agg(F.array_sort(F.collect_list(F.struct(pos, node))).alias("_n")).select(path, F.col(f"_n.{node}").alias("nodes"))


def street_ways(roads: DataFrame, name: str = "name", kind: str = "highway", footway: str = "footway") -> DataFrame:
    """Rows of roads that make streets: base roads of no excluded class, and cycleways that are streets of their own.

    A cycleway stays if it is listed, or if it is called like a street and no road has its name or one within an edit.
    """
    base = roads.where(base_road(F.col(name), F.col(footway)))
    plain = excluded(F.col(kind), fixed.EXCLUDED_ROADS)
    streets, others = base.where(plain), base.where(~plain & (F.col(kind) == "cycleway"))
    own = F.col(name).isin(*fixed.CYCLE_KEEP)
    looks = F.lit(False)
    for prefix in fixed.CYCLE_PREFIX:
        looks = looks | F.startswith(F.col(name), F.lit(prefix))
    names = streets.select(name).distinct()
    new = others.where(~own & looks).join(names, name, "left_anti").withColumn("_key", text.key_alnum(F.col(name)))
    new = without_close(new, names.select(text.key_alnum(F.col(name)).alias("_key")), "_key").select(*roads.columns)
    return streets.unionByName(others.where(own)).unionByName(new)


def history_board(title: Column, operator: Column) -> Column:
    """City-operated boards."""
    return F.contains(F.lower(operator), F.lit("de paris")) | F.startswith(F.lower(title), F.lit("histoire de paris"))


def with_picture(commons: Column, image: Column) -> Column:
    return (F.coalesce(commons, F.lit("")) != "") | (F.coalesce(image, F.lit("")) != "")


def readable(n_words: Column, known: Column) -> Column:
    """Machine-read text that is long enough and mostly known words."""
    return (n_words >= 15) & (known >= 0.42)
