"""Queries over whole builds of a city's tables, on towns laid out from the supplied points and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.functions import picture
from terralex.functions import text as T
from terralex.operators import city, fuzzy, planar
from terralex.plans.spatial_queries import AREAS, HOLE, LAT0, LINES, ON_LINE, POINTS, TO_LINE, grid_lines, in_ring_sql, points
from terralex.plans.spatial_queries import _streets as streets
from terralex.plans.text_queries import read

SHAPE = "array<struct<x:double,y:double>>"


def search_keys(spark, d):
    """Streets by both of their keys."""
    size = F.element_at(F.array(*[F.lit(x) for x in ("Rue de la", "Place du", "Porte", "Rue Saint")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    names = read(spark, d, "part").select(F.concat_ws(" ", size, "p_name").alias("name"), "p_partkey")
    return fuzzy.search_keys(fuzzy.street_keys(names, "name", "p_partkey"), "porte blue widgit").select("name", "distance", "grade", F.array_join("keys", ",").alias("keys"))


def register_inputs(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(roads, ways, nodes, commune): one road for every point, with names in some of the columns; a map's ways beside them."""
    p = points(spark, d).select("vec_id", F.round(F.col("x") * 4000, 2).alias("x"), F.round(F.col("y") * 4000, 2).alias("y"), F.expr("vec_id div 4").cast("string").alias("k"), (F.col("vec_id") % 5).alias("m"))
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    kinds = F.array(*[F.lit(x) for x in ("Sentier", "Chemin", "Route à 1 chaussée", "Autre")])
    name = lambda m, *words: F.when(F.col("m") == m, F.concat(*words))
    roads = p.select(
        F.col("vec_id").alias("road"), F.element_at(kinds, (F.col("vec_id") % 4 + 1).cast("int")).alias("nature"), name(0, F.lit("Rue N"), "k").alias("ban_left"), name(1, F.lit("Avenue É"), "k").alias("ban_right"),
        name(2, F.when(F.col("vec_id") % 3 == 0, "").otherwise(F.concat(F.lit("Voie M/"), "k"))).alias("route_name"), name(3, F.lit("AV DES LILAS "), "k").alias("note_left"), F.lit(None).cast("string").alias("note_right"),
        F.array(F.array(at(0, 0), at(40, 15), at(70, 15))).alias("parts"),
    )
    own = p.where("m IN (0, 4)").select("vec_id", "k", F.posexplode(F.array(at(0.8, 0.5), at(40.8, 15.5), at(70.8, 15.5))).alias("pos", "p"))
    node = (F.col("vec_id") * 10 + F.col("pos")).alias("node")
    ways = own.select(F.col("vec_id").alias("way"), F.concat(F.lit("rue n"), "k").alias("name"), F.when(F.col("vec_id") % 6 == 0, "steps").otherwise("residential").alias("highway"), F.lit(None).cast("string").alias("footway"), "pos", node)
    nodes = own.where("NOT (vec_id % 7 = 0 AND pos = 1)").select(node, "p.x", "p.y")
    commune = spark.createDataFrame([(0, [{"x": x * 4000, "y": y * 4000} for x, y in AREAS[2][1]], [])], f"area_idx int, shell {SHAPE}, holes array<{SHAPE}>")
    return roads, ways, nodes, commune


def street_register(spark, d):
    return city.street_register(*register_inputs(spark, d)).select("road", "name", "origin", F.size(F.flatten("parts")).alias("n_points"))


def _areas(spark, scale: float = 1.0):
    ring = lambda r: [{"x": x * scale, "y": y * scale} for x, y in r]
    return spark.createDataFrame([(i, f"quartier {'BAB'[i]}", ring(r), [ring(HOLE)] if i == 2 else []) for i, r in AREAS], f"area_idx int, label string, shell {SHAPE}, holes array<{SHAPE}>")


def street_export(spark, d):
    """The street town's export: names, lengths, simplified paths and areas."""
    edges = planar.street_edges(planar.planarized(streets(spark, d)))
    made = city.street_export(edges, _areas(spark, 4000.0).drop("label"), LAT0)
    return made.select("edge", "name", "km", F.size("crossings").alias("n_crossings"), F.size("paths").alias("n_paths"), F.size(F.flatten("paths")).alias("n_points"), "area")


def tagged_streets(spark, d):
    """Every short street's quartier, by its middle point."""
    lines = grid_lines(spark, d).select(F.col("line_id").alias("edge"), F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))).alias("line"))
    return city.tagged_streets(lines, _areas(spark), 0.05)


def _label_sql(i: int) -> str:
    inside = in_ring_sql(AREAS[i][1]) + (f" AND NOT {in_ring_sql(HOLE)}" if i == 2 else "")
    return f"WHEN {inside} THEN 'quartier {'BAB'[i]}'"


TAGGED_STREETS = f"""
WITH {POINTS}, {LINES}, m AS (SELECT line_id AS edge, bx AS x, by_ AS y FROM l), t AS (SELECT edge, CASE {' '.join(map(_label_sql, range(3)))} END AS label FROM m)
SELECT edge, label, coalesce(CASE label WHEN 'quartier A' THEN 0 WHEN 'quartier B' THEN 1 END, -1)::BIGINT AS tag FROM t
"""


def _cells(spark, d) -> DataFrame:
    """A square for each nation, five in a row."""
    x, y = F.col("n_nationkey") % 5, F.expr("n_nationkey div 5")
    at = lambda i, j: F.struct((x + i).cast("double").alias("x"), (y + j).cast("double").alias("y"))
    return read(spark, d, "nation").select(T.label_number(F.col("n_name")).alias("number"), F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).alias("ring"))


def bank_outlines(spark, d):
    """How many whole sides either bank's outline has."""
    out = city.bank_outlines(_cells(spark, d))
    return out.groupBy("bank").agg(F.count("*").alias("n_sides"), F.round(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2, 6).alias("area"))


BANK_OUTLINES = """
WITH c AS (SELECT CASE WHEN n_nationkey IN (5, 6, 7, 13, 14, 15) THEN 'left' ELSE 'right' END AS bank, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation),
s AS (SELECT bank, x, y, 0 AS up FROM c UNION ALL SELECT bank, x, y + 1, 0 FROM c UNION ALL SELECT bank, x, y, 1 FROM c UNION ALL SELECT bank, x + 1, y, 1 FROM c),
o AS (SELECT bank, x, y, up FROM s GROUP BY ALL HAVING count(*) = 1)
SELECT bank, count(*)::BIGINT AS n_sides, (SELECT count(*) FROM c WHERE c.bank = o.bank)::DOUBLE AS area FROM o GROUP BY bank
"""


def islands(spark, d):
    """The two largest rectangles of a table of holes whose centre lies in a window."""
    k = F.col("s_suppkey")
    x, y, w, h = (k % 37) / 10, (k % 23) / 10, (k % 11 + 1) / 10, (k % 7 + 1) / 10
    at = lambda i, j: F.struct((x + i).alias("x"), (y + j).alias("y"))
    holes = read(spark, d, "supplier").select(k.alias("hole"), F.array(at(0, 0), at(w, 0), at(w, h), at(0, h)).alias("ring"))
    return city.islands(holes, (1.0, 0.5), (3.0, 2.0)).select("hole", F.round("envelope", 9).alias("envelope"))


ISLANDS = """
WITH h AS (SELECT s_suppkey AS hole, s_suppkey % 37 / 10 AS x, s_suppkey % 23 / 10 AS y, (s_suppkey % 11 + 1) / 10 AS w, (s_suppkey % 7 + 1) / 10 AS h FROM supplier),
e AS (SELECT hole, round(w * h, 9) AS envelope, x + w / 2 AS cx, y + h / 2 AS cy FROM h)
SELECT hole, envelope FROM e WHERE cx > 1.0 + 1e-9 AND cx < 3.0 - 1e-9 AND cy > 0.5 + 1e-9 AND cy < 2.0 - 1e-9 ORDER BY envelope DESC, hole LIMIT 2
"""


def plaque_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    """(export, segments): documents as plaques, with places in either form or none; the short streets in degrees."""
    k = F.col("doc_id")
    lat, lon = (k % 211) / 1000 - 0.1, (k % 197) / 1000 - 0.1
    docs = read(spark, d, "documents").select(
        k.alias("id"), F.when(k % 3 == 0, F.struct(lat.alias("lat"), lon.alias("lon"))).alias("geo_point_2d"), F.when(k % 5 > 0, lon).alias("x_4326"), F.when(k % 7 > 0, lat).otherwise(0.0).alias("y_4326"),
        F.when(k % 4 > 0, F.concat(F.lit("_x008E_ [italique : "), F.substring_index("text", " ", 3), F.lit("] [sic]"))).alias("titre"), F.when(k % 4 > 1, F.upper("text")).alias("retranscription"), F.col("source").alias("adresse"),
    )
    return docs, grid_lines(spark, d)


def plaque_build(spark, d):
    made = city.plaques(*plaque_inputs(spark, d), 0.02)
    return made.select("id", "la", "lo", F.md5("t").alias("t"), F.md5("r").alias("r"), F.md5("a").alias("a"), "ei")


def panel_final(spark, d):
    """Panels whose text comes from one of three sources, each near a street."""
    k = F.col("doc_id")
    docs = read(spark, d, "documents").select(k.alias("id"), (k % 211 / 1000 - 0.1).alias("lat"), (k % 197 / 1000 - 0.1).alias("lon"), F.concat(F.lit("Panneau "), k).alias("title"), F.when(k % 3 == 0, F.col("text")).alias("osm"))
    talk = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", "turn").alias("vlm"))
    scan = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("ocr"))
    made = city.final_panels(docs.join(talk, "id", "left").join(scan, "id", "left"), ["osm", "vlm", "ocr"], "ocr", grid_lines(spark, d), 0.02)
    return made.select("id", "la", "lo", "t", F.md5("r").alias("r"), "ei", "src", "conf")


PANEL_FINAL = f"""
WITH {POINTS}, {LINES}, talk AS (SELECT conv_id AS id, arg_min(text, turn) AS vlm FROM conversations GROUP BY 1),
j AS (SELECT doc_id AS id, doc_id % 211 / 1000 - 0.1 AS lat, doc_id % 197 / 1000 - 0.1 AS lon, CASE WHEN doc_id % 3 = 0 THEN d.text END AS osm, vlm, b.text AS ocr FROM documents d LEFT JOIN talk ON talk.id = doc_id LEFT JOIN benchmark b ON b.item_id = doc_id),
n AS (SELECT *, coalesce(length(osm), 0) AS a, coalesce(length(vlm), 0) AS b, coalesce(length(ocr), 0) AS c FROM j),
s AS (SELECT *, CASE WHEN a >= 80 THEN 'osm' WHEN b >= 80 THEN 'vlm' WHEN c >= 80 THEN 'ocr' WHEN greatest(a, b, c) = 0 THEN NULL WHEN a = greatest(a, b, c) THEN 'osm' WHEN b = greatest(a, b, c) THEN 'vlm' ELSE 'ocr' END AS src FROM n),
w AS (SELECT *, CASE src WHEN 'osm' THEN osm WHEN 'vlm' THEN vlm ELSE ocr END AS body FROM s WHERE src IS NOT NULL),
v AS (SELECT *, list_distinct(regexp_extract_all(lower(body), '[a-zà-ÿ]{{4,}}')) AS ws FROM w),
places AS (SELECT DISTINCT lat AS y, lon AS x FROM v),
near AS (SELECT x, y, arg_min(line_id, row(dist, line_id)) AS ei FROM (SELECT x, y, line_id, {TO_LINE} AS dist FROM (SELECT *, {ON_LINE} AS t FROM places CROSS JOIN l)) GROUP BY x, y)
SELECT id, round(lat, 5) AS la, round(lon, 5) AS lo, 'Panneau ' || id AS t, md5(body) AS r, ei, src,
  CASE WHEN src <> 'ocr' THEN 'high' WHEN greatest(len(list_intersect(ws, regexp_extract_all(lower(coalesce(osm, '')), '[a-zà-ÿ]{{4,}}'))), len(list_intersect(ws, regexp_extract_all(lower(coalesce(vlm, '')), '[a-zà-ÿ]{{4,}}')))) / greatest(1, len(ws)) >= 0.5 THEN 'high' ELSE 'low' END AS conf
FROM v JOIN near ON v.lon = near.x AND v.lat = near.y
"""


def panel_crops(spark, d):
    """Where to crop pictures whose dark shares are the embeddings' sizes."""
    bounds = picture.panel_bounds(F.transform("embedding", lambda v: F.abs(v.cast("double")) * 4))
    return read(spark, d, "embeddings").select("vec_id", bounds.alias("b")).select("vec_id", "b.x0", "b.x1")


PANEL_CROPS = """
WITH e AS (SELECT vec_id, len(embedding) AS w, abs(unnest(embedding)::DOUBLE) * 4 AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
o AS (SELECT vec_id, w, i, v > greatest(0.3, max(v) OVER (PARTITION BY vec_id) * 0.5) AS hit FROM e),
r AS (SELECT vec_id, w, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS island FROM o WHERE hit),
g AS (SELECT vec_id, w, min(i) - 1 AS a, max(i) AS b FROM r GROUP BY vec_id, w, island),
b AS (SELECT vec_id, w, arg_min(a, row(a - b, a)) AS a, arg_min(b, row(a - b, a)) AS b FROM g GROUP BY vec_id, w),
f AS (SELECT vec_id, len(embedding) AS w, coalesce(a, 0) AS a, coalesce(b, len(embedding)) AS b FROM embeddings LEFT JOIN b USING (vec_id))
SELECT vec_id, CASE WHEN b - a < w * 0.2 THEN 0 ELSE greatest(0, a - floor((b - a) * 0.13)) END::INTEGER AS x0, CASE WHEN b - a < w * 0.2 THEN w ELSE least(w, b + floor((b - a) * 0.13)) END::INTEGER AS x1 FROM f
"""


def block_rings(spark, d):
    """The street town's blocks as a map shows them."""
    edges = planar.street_edges(planar.planarized(streets(spark, d)))
    made = city.block_rings(planar.faces(edges), 1.3, 3)
    return made.select("face.a", "face.b", F.size("ring").alias("n_corners"), F.round("centre.x", 3).alias("cx"), F.round("centre.y", 3).alias("cy"), F.size("edges").alias("n_edges"))


ALL = {
    "search_keys": (search_keys, None),
    "street_register": (street_register, None),
    "street_export": (street_export, None),
    "tagged_streets": (tagged_streets, TAGGED_STREETS),
    "bank_outlines": (bank_outlines, BANK_OUTLINES),
    "islands": (islands, ISLANDS),
    "plaque_build": (plaque_build, None),
    "panel_final": (panel_final, PANEL_FINAL),
    "panel_crops": (panel_crops, PANEL_CROPS),
    "block_rings": (block_rings, None),
}
