"""Whole builds of a city's tables: the street register, the export of streets, tags of areas and banks, plaques."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from terralex.functions import fixed, geo
from terralex.functions import text as T
from terralex.operators import filters, planar, spatial
from terralex.operators.graph import compact_index
from terralex.operators.resolve import chosen, confidence, first_value
from terralex.sources import maps
from terralex.sources.sinks import missing
from terralex.staging import stage

SEGMENT = ("ax", "ay", "bx", "by")


def segments_of_parts(df: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    """(key, ax, ay, bx, by): the segments of geometries that are arrays of lines."""
    leg = df.select(key, F.explode(parts).alias("_line")).select(key, F.explode(geo.legs(F.col("_line"))).alias("s"))
    return leg.select(key, F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def clipped(df: DataFrame, key: str, areas: DataFrame, cell: float) -> DataFrame:
    """Rows (with ``parts``) that have a point in common with an area (area_idx, shell, holes); they stay whole."""
    vertices = df.select(key, F.explode(F.flatten("parts")).alias("p")).select(key, "p.x", "p.y")
    inside = spatial.areas_of(vertices, areas, key, "x", "y", cell).where("area_idx >= 0").select(key)
    rings = areas.select(F.explode(F.concat(F.array("shell"), "holes")).alias("ring")).select(F.explode(geo.sides(F.col("ring"))).alias("s")).select("s.*")
    own = planar.covered(segments_of_parts(df, key), cell, 0.0)
    sides = planar.covered(rings, cell, 0.0).toDF(*[f"q{c}" for c in SEGMENT], "cx", "cy")
    meet = geo.segments_meet(tuple(F.col(c) for c in SEGMENT), tuple(F.col(f"q{c}") for c in SEGMENT))
    crossing = own.join(sides, ["cx", "cy"]).where(meet).select(key)
    return df.join(inside.union(crossing).distinct(), key, "left_semi")


def samples(line: Column, step: float) -> Column:
    """The vertices of a line and points between them, at most ``step`` apart, each once."""
    inner = F.flatten(F.transform(geo.legs(line), lambda s: F.slice(d := geo.densified(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], step), F.lit(1), F.size(d) - 1)))
    return F.concat(inner, F.array(F.struct(F.element_at(line, -1)["x"].alias("x"), F.element_at(line, -1)["y"].alias("y"))))


def donors(ways: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, ax, ay, bx, by): the streets among ways (way, name, highway, footway, pos, node) whose name the register
    (names: key) has too; nodes (node, x, y) that don't exist are left out, and ways with fewer than two that do."""
    heads = ways.select("way", "name", "highway", "footway").distinct()
    streets = filters.street_ways(heads).withColumn("key", T.key_alnum(F.col("name"))).join(names, "key", "left_semi").select("way", "name")
    located = ways.select("way", "pos", "node").join(streets, "way").join(nodes, "node")
    lines = located.groupBy("way", "name").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p")).select("name", F.array(F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("parts"))
    return segments_of_parts(lines, "name").distinct()


def recovered(roads: DataFrame, streets: DataFrame, mean_max: float = 2.0, worst_max: float = 10.0, least: float = 1.0) -> DataFrame:
    """(road, name) for roads (road, name, parts) without a name that lie on one of the streets: their mean distance over
    samples a metre apart is at most ``mean_max``, none is more than ``worst_max`` away; the least mean wins, then the
    first name. Roads shorter than ``least`` stay as they are."""
    nameless = roads.where("name IS NULL").select("road", "parts")
    length = F.sum(F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2)))
    long = segments_of_parts(nameless, "road").groupBy("road").agg(length.alias("m")).where(F.col("m") >= least).select("road")
    points = nameless.join(long, "road", "left_semi").select("road", F.explode(F.flatten(F.transform(F.filter("parts", lambda p: F.size(p) >= 2), lambda p: samples(p, 1.0)))).alias("p")).select("road", "p.x", "p.y")
    found = spatial.matched_lines(stage(points, "register-samples"), streets.withColumnRenamed("name", "line_id"), "road", mean_max, worst_max)
    return found.select("road", F.col("line_id").alias("name"))


def street_register(roads: DataFrame, ways: DataFrame, nodes: DataFrame, commune: DataFrame, more_kinds: tuple[str, ...] = (), cell: float = 500.0) -> DataFrame:
    """(road, name, origin, parts): the named streets of a register, in metres.

    Roads (road, nature, ban_left, ban_right, route_name, note_left, note_right, parts) of the kinds that are streets and
    that touch the commune (area_idx, shell, holes) take the first official name, else the spelled-out note; those with
    neither take the name of a map's street (``ways``, ``nodes``) that they lie on, if the register has that name. Names
    that are empty or internal codes are left out. ``origin`` is official, note or map.
    """
    kinds = roads.where(F.col("nature").isin(*fixed.ROAD_KINDS, *more_kinds))
    official = filters.precedence(F.col("ban_left"), F.col("ban_right"), F.col("route_name"))
    note = T.expand_abbreviations(filters.precedence(F.col("note_left"), F.col("note_right")))
    origin = F.when(official.isNotNull(), "official").when(note.isNotNull(), "note").otherwise("map")
    named = stage(clipped(kinds, "road", commune, cell).select("road", F.coalesce(official, note).alias("name"), origin.alias("origin"), "parts"), "register")
    keys = named.where(F.trim("name") != "").select(T.key_alnum(F.col("name")).alias("key")).distinct()
    filled = recovered(named, donors(ways, nodes, keys)).withColumnRenamed("name", "_name")
    out = named.join(filled, "road", "left").select("road", F.coalesce("name", "_name").alias("name"), "origin", "parts")
    return out.where((F.col("name") != "") & filters.without_codes(F.col("name")))


def register_lines(register: DataFrame) -> DataFrame:
    """The register's streets as segment rows of the planar build."""
    flat = maps.flattened(register, "road", "name")
    numbered = compact_index(flat.select("line").distinct(), "line", name="number")
    return planar.segments_of(flat.join(numbered, "line").drop("line"), "number", "pos", "name", "x", "y")


PATHS = ArrayType(geo.LINE)


def _chains(pieces: list[dict]) -> list[list[dict]]:
    """The pieces (a, b, ax, ay, bx, by) of a street as few paths: they break where other than two pieces meet."""
    around: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        for node in (p["a"], p["b"]):
            around.setdefault(node, []).append(i)
    starts = sorted(n for n, own in around.items() if len(own) != 2) + sorted(around)  # rings last
    used, out = set(), []
    for start in starts:
        for first in around[start]:
            node, i, path = start, first, []
            while i is not None and i not in used:
                used.add(i)
                p = pieces[i]
                ends = [{"x": p["ax"], "y": p["ay"]}, {"x": p["bx"], "y": p["by"]}]
                if p["a"] != node:
                    ends.reverse()
                node = p["b"] if p["a"] == node else p["a"]
                path += ends[bool(path) :]
                i = next((j for j in around[node] if j not in used), None) if len(around[node]) == 2 else None
            if path:
                out.append(path)
    return out


@F.arrow_udf(PATHS)
def _paths(streets: pa.Array) -> pa.Array:
    return pa.array([_chains(sorted(rows, key=lambda r: (r["a"], r["b"]))) for rows in streets.to_pylist()], pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def street_paths(edges: DataFrame, eps: float) -> DataFrame:
    """(edge, pos, path, n_points): each street's pieces chained into paths and simplified by ``eps`` metres. A task holds
    one street's pieces at a time."""
    rows = edges.groupBy("edge").agg(_paths(F.collect_list(F.struct("a", "b", *SEGMENT))).alias("paths"))
    flat = rows.select("edge", F.posexplode("paths").alias("pos", "whole"))
    return flat.select("edge", "pos", geo.simplify(F.col("whole"), eps).alias("path"), F.size("whole").alias("n_points"))


def street_export(edges: DataFrame, areas: DataFrame, lat0: float, cell: float = 500.0, eps: float = 2.2) -> DataFrame:
    """(edge, name, km, crossings, paths, area): what a map shows of each street. Paths are points (lat, lon) to five
    digits; the area is the first that holds the middle point of the first path, -1 for none."""
    paths = stage(street_paths(edges, eps), "street-paths")
    middle = paths.where("pos = 0").select("edge", geo.middle_point(F.col("path")).alias("p")).select("edge", "p.x", "p.y")
    tagged = spatial.areas_of(middle, areas, "edge", "x", "y", cell).withColumnRenamed("area_idx", "area")

    def shown(p: Column) -> Column:
        lat, lon = geo.local_latlon(p["x"], p["y"], lat0)
        return F.struct(F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"))

    drawn = paths.groupBy("edge").agg(F.array_sort(F.collect_list(F.struct("pos", F.transform("path", shown).alias("path"))))["path"].alias("paths"))
    return planar.edge_table(edges, lat0).join(drawn, "edge").join(tagged, "edge").select("edge", "name", "km", "crossings", "paths", "area")


def block_rings(faces: DataFrame, eps: float, digits: int) -> DataFrame:
    """(face, ring, centre, edges, area): a map's blocks: rings simplified as closed lines, rounded, with the mean of their
    corners; those that have fewer than three left are left out."""
    closed = F.concat("ring", F.slice("ring", 1, 1))
    drawn = stage(faces.withColumn("_line", geo.simplify(closed, eps)), "blocks")
    open_ = F.slice("_line", F.lit(1), F.size("_line") - 1)
    made = drawn.select("face", geo.rounded_ring(open_, digits).alias("ring"), geo.ring_centre(open_).alias("centre"), "edges", "area")
    return made.where(F.size("ring") >= 3)


def tagged_streets(streets: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """(edge, label, tag): the label of the first area (area_idx, label, shell, holes) strictly around the middle point of
    each street (edge, line), and its place among the sorted labels; -1 for none."""
    middle = streets.select("edge", geo.middle_point(F.col("line")).alias("p")).select("edge", "p.x", "p.y")
    found = spatial.areas_of(middle, areas, "edge", "x", "y", cell, strict=True)
    labels = compact_index(areas.select("label").distinct(), "label", name="tag")
    named = areas.select("area_idx", "label").join(labels, "label")
    return found.join(named, "area_idx", "left").select("edge", "label", F.coalesce("tag", F.lit(-1).cast("long")).alias("tag"))


def bank_outlines(areas: DataFrame) -> DataFrame:
    """(bank, ax, ay, bx, by): the outline of either bank's numbered areas (number, ring); areas without a number belong
    to neither. Areas must share whole sides."""
    bank = F.when(F.col("number").isin(*fixed.LEFT_BANK), "left").otherwise("right")
    return planar.dissolved(areas.where("number IS NOT NULL").select(bank.alias("bank"), "ring"), "bank")


def islands(holes: DataFrame, low: tuple[float, float], high: tuple[float, float], most: int = 2) -> DataFrame:
    """(hole, ring, envelope): of the holes (hole, ring) in a water surface whose centre lies in a window, the ``most`` with
    the largest envelopes; the first hole wins a tie. Envelopes are told apart to 1e-9, and a centre within 1e-9 of the
    window's side isn't inside, so that rounding of the last digit decides nothing."""
    centre = geo.ring_centre(F.col("ring"))
    within = lambda v, a, b: (v > a + 1e-9) & (v < b - 1e-9)
    inside = holes.where(within(centre["x"], low[0], high[0]) & within(centre["y"], low[1], high[1]))
    return inside.select("hole", "ring", F.round(geo.envelope_area(F.col("ring")), 9).alias("envelope")).orderBy(F.desc("envelope"), "hole").limit(most)


def plaques(export: DataFrame, segments: DataFrame, cell: float) -> DataFrame:
    """(id, la, lo, t, r, a, ei): plaques of an export (id, geo_point_2d, x_4326, y_4326, titre, retranscription, adresse)
    with cleaned texts and the nearest street of segments (line_id, ax, ay, bx, by) in degrees. Rows without a place, or
    with neither title nor text, are left out."""
    cleaned = lambda c: T.clean_export(F.coalesce(F.col(c), F.lit("")))
    placed = maps.export_position(export).select("id", "lat", "lon", cleaned("titre").alias("t"), T.calm(cleaned("retranscription")).alias("r"), cleaned("adresse").alias("a"))
    told = stage(placed.where("t <> '' OR r <> ''"), "plaques")
    near = spatial.nearest_lines(told, segments, "id", "lon", "lat", cell).select("id", F.col("line_id").alias("ei"))
    return told.join(near, "id").select("id", F.round("lat", 5).alias("la"), F.round("lon", 5).alias("lo"), "t", "r", "a", "ei")


def final_panels(panels: DataFrame, sources: list[str], weak: str, segments: DataFrame, cell: float) -> DataFrame:
    """(id, la, lo, t, r, ei, src, conf): panels (id, lat, lon, title and a text column for each source) with the text of
    the source of most trust, how far it can be trusted, and the nearest street; panels without any text are left out."""
    texts = [(s, F.col(s)) for s in sources]
    src, text = chosen(texts)
    told = panels.withColumn("_src", src).withColumn("_text", text).where("_src IS NOT NULL")
    told = stage(told.select("id", "lat", "lon", "title", "_text", "_src", confidence(F.col("_src"), F.col("_text"), texts, weak).alias("conf")), "panels")
    near = spatial.nearest_lines(told, segments, "id", "lon", "lat", cell).select("id", F.col("line_id").alias("ei"))
    return told.join(near, "id").select("id", F.round("lat", 5).alias("la"), F.round("lon", 5).alias("lo"), F.col("title").alias("t"), F.col("_text").alias("r"), "ei", F.col("_src").alias("src"), "conf")


def boards(found: DataFrame) -> DataFrame:
    """(osm, lat, lon, title, subject, text, commons, image, wikidata, operator, history): information boards among map
    elements that have a place, with cleaned texts; ``history`` tells the city's own ones."""
    tag = lambda k: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit(""))
    title = T.clean_panel(F.coalesce(*[F.nullif(tag(k), F.lit("")) for k in fixed.BOARD_TITLES], F.lit("")))
    told = maps.located(found).select(
        F.concat_ws("/", "type", "id").alias("osm"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), title.alias("title"), F.trim(tag("description")).alias("subject"),
        T.clean_panel(T.joined_parts(*[tag(k) for k in fixed.INSCRIPTIONS])).alias("text"), tag("wikimedia_commons").alias("commons"), tag("image").alias("image"), tag("wikidata").alias("wikidata"), tag("operator").alias("operator"),
    )
    return told.withColumn("history", filters.history_board(F.col("title"), F.col("operator")))


def pictures_to_fetch(found: DataFrame, stored: DataFrame, base: str) -> DataFrame:
    """(key, url): a work list of the city's own boards with a picture that isn't among the stored keys yet."""
    wanted = found.where(F.col("history") & filters.with_picture(F.col("commons"), F.col("image")))
    listed = wanted.select(T.slug(F.col("osm")).alias("key"), T.image_url(base, F.col("image"), F.col("commons")).alias("url"))
    return missing(listed, stored, "key")


def panel_sources(found: DataFrame, read: DataFrame, pages: DataFrame, scans: DataFrame) -> DataFrame:
    """(id, lat, lon, title, osm, vlm, rohee, ocr): the city's own boards with what each source tells: the map, readings
    (osm, text), archived pages (path, title, text; the first path of a title counts) and machine-read scans (osm, text)."""
    own = found.where("history").select(F.col("osm").alias("id"), "lat", "lon", "title", F.nullif(F.col("text"), F.lit("")).alias("osm"))
    reading = read.where(F.trim("text") != "").select(F.col("osm").alias("id"), F.trim("text").alias("vlm"))
    page = first_value(pages.select(T.key_words(F.col("title")).alias("key"), F.col("text").alias("rohee"), "path"), "key", "rohee", "path")
    scan = scans.select(F.col("osm").alias("id"), F.col("text").alias("ocr"))
    keyed = own.join(reading, "id", "left").withColumn("key", T.key_words(F.col("title"))).join(page, "key", "left").drop("key")
    return keyed.join(scan, "id", "left").select("id", "lat", "lon", "title", "osm", "vlm", "rohee", "ocr")


def district_areas(found: DataFrame) -> DataFrame:
    """(area_idx, label, shell, holes): boundary relations with their stitched outer ring, by number; labels without one
    come last."""
    rings = maps.outer_parts(found).select(T.district(F.coalesce("name", F.lit("?"))).alias("label"), planar.stitch_rings(F.col("parts")).alias("shell"))
    numbered = rings.withColumn("_n", F.coalesce(F.col("label").try_cast("int"), F.lit(999)))
    return compact_index(numbered, "_n", "label", name="area_idx").select("area_idx", "label", "shell", F.array().cast(f"array<{geo.LINE.simpleString()}>").alias("holes"))


def layer_areas(df: DataFrame, *name_columns: str) -> DataFrame:
    """(area_idx, label, shell, holes): areas of a layer (``parts``: rings) by their largest ring, numbered by what is in
    the first of the name columns that the layer has."""
    name = maps.first_column(df, *name_columns)
    number = T.label_number(F.col(name))
    rows = df.select(F.coalesce(number.cast("string"), F.col(name)).alias("label"), geo.largest_ring(F.col("parts")).alias("shell"), F.coalesce(number, F.lit(999)).alias("_n"))
    return compact_index(rows, "_n", "label", name="area_idx").select("area_idx", "label", "shell", F.array().cast(f"array<{geo.LINE.simpleString()}>").alias("holes"))
