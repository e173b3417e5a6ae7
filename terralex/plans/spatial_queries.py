"""Queries over points, lines and graphs: embeddings as points, events as paths, part-supplier rows as a graph."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex.functions import geo
from terralex.operators import graph, ordered, planar, spatial

LAT0 = 48.86
#: Metres between the middles of neighbouring quarters of the street town; their streets overlap.
QUARTER_M = 1500.0


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def points(spark, d) -> DataFrame:
    at = lambda i: F.element_at("embedding", i).cast("double")
    return _read(spark, d, "embeddings").select("vec_id", "label", at(1).alias("x"), at(2).alias("y"))


POINTS = "p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def nearest_neighbour(spark, d):
    return spatial.nearest_points(points(spark, d), "vec_id", "x", "y", 0.05).select(F.col("id").alias("vec_id"), "nearest", F.round("dist", 9).alias("dist"))


NEAREST_NEIGHBOUR = f"""
WITH {POINTS}, d AS (SELECT a.vec_id, b.vec_id AS nearest, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM p a JOIN p b ON a.vec_id <> b.vec_id)
SELECT vec_id, arg_min(nearest, row(dist, nearest)) AS nearest, round(min(dist), 9) AS dist FROM d GROUP BY vec_id
"""


def grid_lines(spark, d) -> DataFrame:
    """One short street from each point with an even id to the point (y, x) scaled down."""
    p = points(spark, d).where("vec_id % 2 = 0")
    return p.select(F.col("vec_id").alias("line_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") * 0.9 + 0.02).alias("bx"), (F.col("y") * 0.8 - 0.01).alias("by"))


LINES = "l AS (SELECT vec_id AS line_id, x AS ax, y AS ay, x * 0.9 + 0.02 AS bx, y * 0.8 - 0.01 AS by_ FROM p WHERE vec_id % 2 = 0)"
ON_LINE = "greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2))))"
TO_LINE = "sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * (by_ - ay)), 2))"


def nearest_line(spark, d):
    odd = points(spark, d).where("vec_id % 2 = 1")
    return spatial.nearest_lines(odd, grid_lines(spark, d), "vec_id", "x", "y", 0.02).select("vec_id", "line_id", F.round("dist", 9).alias("dist"))


NEAREST_LINE = f"""
WITH {POINTS}, {LINES}, d AS (SELECT vec_id, line_id, {TO_LINE} AS dist FROM (SELECT *, {ON_LINE} AS t FROM p CROSS JOIN l WHERE vec_id % 2 = 1))
SELECT vec_id, arg_min(line_id, row(dist, line_id)) AS line_id, round(min(dist), 9) AS dist FROM d GROUP BY vec_id
"""


def within_radius(spark, d):
    found = spatial.pairs_within(points(spark, d), "vec_id", "x", "y", 0.02)
    return found.groupBy(F.col("a").alias("vec_id")).agg(F.count("*").alias("n"), F.round(F.avg("dist"), 9).alias("mean_dist"), F.round(F.max("dist"), 9).alias("max_dist"))


WITHIN_RADIUS = f"""
WITH {POINTS}, d AS (SELECT a.vec_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM p a JOIN p b ON a.vec_id < b.vec_id)
SELECT vec_id, count(*)::BIGINT AS n, round(avg(dist), 9) AS mean_dist, round(max(dist), 9) AS max_dist FROM d WHERE dist <= 0.02 GROUP BY vec_id
"""


def matched_streets(spark, d):
    """Each point's walk of four samples against the lines: within reach all along, least mean distance."""
    p = points(spark, d).where("vec_id % 2 = 1")
    steps = p.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "x", "y")
    samples = steps.select("vec_id", (F.col("x") + F.col("k") * 0.01).alias("x"), (F.col("y") - F.col("k") * 0.005).alias("y"))
    found = spatial.matched_lines(samples, grid_lines(spark, d), "vec_id", 0.04, 0.06)
    return found.select("vec_id", "line_id", F.round("mean_dist", 9).alias("mean_dist"), F.round("max_dist", 9).alias("max_dist"))


MATCHED_STREETS = f"""
WITH {POINTS}, {LINES}, s AS (SELECT vec_id, x + k * 0.01 AS x, y - k * 0.005 AS y FROM p CROSS JOIN range(4) r(k) WHERE vec_id % 2 = 1),
d AS (SELECT vec_id, line_id, {TO_LINE} AS dist FROM (SELECT *, {ON_LINE} AS t FROM s CROSS JOIN l)),
m AS (SELECT vec_id, line_id, avg(dist) AS mean_dist, max(dist) AS max_dist FROM d GROUP BY ALL HAVING avg(dist) <= 0.04 AND max(dist) <= 0.06)
SELECT vec_id, arg_min(line_id, row(mean_dist, line_id)) AS line_id, round(min(mean_dist), 9) AS mean_dist, round(arg_min(max_dist, row(mean_dist, line_id)), 9) AS max_dist FROM m GROUP BY vec_id
"""

#: Areas: hexagons around the middle, the last with a hole; order decides.
AREAS = [(i, [(r * math.cos(math.tau * k / 6) + cx, r * math.sin(math.tau * k / 6) + cy) for k in range(6)]) for i, (cx, cy, r) in enumerate([(0.05, 0.03, 0.06), (-0.08, 0.02, 0.09), (0.0, -0.05, 0.15)])]
HOLE = [(-0.02, -0.12), (0.02, -0.12), (0.02, -0.08), (-0.02, -0.08)]


def point_in_area(spark, d):
    ring = lambda r: [{"x": x, "y": y} for x, y in r]
    shape = "array<struct<x:double,y:double>>"
    areas = spark.createDataFrame([(i, ring(r), [ring(HOLE)] if i == 2 else []) for i, r in AREAS], f"area_idx int, shell {shape}, holes array<{shape}>")
    return spatial.areas_of(points(spark, d), areas, "vec_id", "x", "y", 0.05)


def in_ring_sql(ring) -> str:
    sides = zip(ring, [ring[-1], *ring[:-1]], strict=True)
    tests = [f"((({ay!r} > y) <> ({by!r} > y)) AND x < ({bx!r} - {ax!r}) * (y - {ay!r}) / nullif({by!r} - {ay!r}, 0) + {ax!r})::INT" for (ax, ay), (bx, by) in sides]
    return f"coalesce(({' + '.join(f'coalesce({t}, 0)' for t in tests)}) % 2 = 1, false)"


POINT_IN_AREA = f"""
WITH {POINTS} SELECT vec_id, CASE {' '.join(f'WHEN {in_ring_sql(r)}' + (f' AND NOT {in_ring_sql(HOLE)}' if i == 2 else '') + f' THEN {i}' for i, r in AREAS)} ELSE -1 END AS area_idx FROM p
"""


def path_length_km(spark, d):
    """Length of each user's walk: event values as degrees, in the order of time."""
    rows = _read(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") / 1000 + 48.8).alias("lat"), (F.col("event_id") % 100 / 1000 + 2.3).alias("lon"))
    legs = ordered.consecutive(rows, "user_id", ["ts", "event_id"], "lat", "lon")
    metres = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon"))
    return legs.groupBy("user_id").agg(F.round(F.sum(metres) / 1000, 6).alias("km"), F.count("*").alias("legs"))


PATH_LENGTH_KM = """
WITH e AS (SELECT user_id, ts, event_id, value / 1000 + 48.8 AS lat, event_id % 100 / 1000 + 2.3 AS lon FROM events),
l AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT user_id, pow(sin((radians(lat2) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2) AS h FROM l WHERE lat2 IS NOT NULL)
SELECT user_id, round(sum(2 * 6371000.0 * asin(sqrt(h))) / 1000, 6) AS km, count(*)::BIGINT AS legs FROM h GROUP BY user_id
"""


def path_simplified(spark, d):
    """Douglas-Peucker over each user's walk in local metres: how many points stay."""
    x, y = geo.local_xy(F.col("value") / 1000 + 48.8, F.col("event_id") % 100 / 1000 + 2.3, LAT0)
    rows = _read(spark, d, "events").select("user_id", F.struct("ts", "event_id", x.alias("x"), y.alias("y")).alias("p"))
    line = F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    paths = rows.groupBy("user_id").agg(line.alias("line"))
    return paths.select("user_id", F.size("line").alias("n"), F.size(geo.simplify(F.col("line"), 2000.0)).alias("n_kept"))


def _graph(spark, d) -> DataFrame:
    """Part-supplier edges, with repeats: what reads them drops these itself."""
    return _read(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))


EDGES = "e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem)"


def part_components(spark, d):
    return graph.components(_graph(spark, d))


PART_COMPONENTS = f"""
WITH RECURSIVE {EDGES}, n AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
r AS (SELECT u AS node, u AS here FROM n UNION SELECT r.node, n.v FROM r JOIN n ON n.u = r.here)
SELECT node, min(here) AS component FROM r GROUP BY node
"""


def largest_network(spark, d):
    return graph.largest_component(graph.components(_graph(spark, d)))


LARGEST_NETWORK = f"""
WITH RECURSIVE {EDGES}, n AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
r AS (SELECT u AS node, u AS here FROM n UNION SELECT r.node, n.v FROM r JOIN n ON n.u = r.here),
c AS (SELECT node, min(here) AS component FROM r GROUP BY node), s AS (SELECT component, count(*) AS k FROM c GROUP BY 1)
SELECT node, component FROM c WHERE component = (SELECT component FROM s ORDER BY k DESC, component LIMIT 1)
"""


def shared_nodes(spark, d):
    return graph.shared_nodes(_read(spark, d, "lineitem"), "l_partkey", "l_suppkey")


SHARED_NODES = "SELECT l_partkey, count(DISTINCT l_suppkey)::BIGINT AS n_edges FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2"


def edge_neighbours(spark, d):
    return graph.edge_neighbours(_graph(spark, d), "a", "b")


EDGE_NEIGHBOURS = f"WITH {EDGES} SELECT x.b, count(DISTINCT y.b)::BIGINT AS n_neighbours FROM e x JOIN e y ON x.a = y.a AND x.b <> y.b GROUP BY 1"


def compact_ids(spark, d):
    return graph.compact_index(_read(spark, d, "customer").select("c_name"), "c_name")


COMPACT_IDS = "SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS idx FROM customer"


def _streets(spark, d) -> DataFrame:
    """Streets through all points in metres: one for every four ids. Every 160 ids make a quarter, and quarters are laid
    out as a growing square, so the town's area grows with the table and its density does not."""
    quarter = F.expr("vec_id div 160")
    shell = F.floor(F.sqrt(quarter))
    place = quarter - shell * shell
    at = lambda f, cell: F.round(F.col(f) * 4000) + cell * QUARTER_M
    p = points(spark, d).select(F.expr("vec_id div 4").alias("k"), at("x", F.least(place, shell)).alias("x"), at("y", F.least(shell * 2 - place, shell)).alias("y"), "vec_id")
    return planar.segments_of(p, "k", "vec_id", "k", "x", "y").withColumn("name", F.concat(F.lit("rue "), "name"))


def street_graph(spark, d):
    edges = planar.street_edges(planar.planarized(_streets(spark, d)))
    return planar.edge_table(edges, LAT0).select("edge", "name", "km", F.size("crossings").alias("n_crossings"))


def city_blocks(spark, d):
    edges = planar.street_edges(planar.planarized(_streets(spark, d)))
    found = planar.faces(edges)
    return found.select("face.a", "face.b", F.round("area").cast("long").alias("area_m2"), F.size("edges").alias("n_edges"), F.size("ring").alias("n_corners"))


ALL = {
    "nearest_neighbour": (nearest_neighbour, NEAREST_NEIGHBOUR),
    "nearest_line": (nearest_line, NEAREST_LINE),
    "within_radius": (within_radius, WITHIN_RADIUS),
    "matched_streets": (matched_streets, MATCHED_STREETS),
    "point_in_area": (point_in_area, POINT_IN_AREA),
    "path_length_km": (path_length_km, PATH_LENGTH_KM),
    "path_simplified": (path_simplified, None),
    "part_components": (part_components, PART_COMPONENTS),
    "largest_network": (largest_network, LARGEST_NETWORK),
    "shared_nodes": (shared_nodes, SHARED_NODES),
    "edge_neighbours": (edge_neighbours, EDGE_NEIGHBOURS),
    "compact_ids": (compact_ids, COMPACT_IDS),
    "street_graph": (street_graph, None),
    "city_blocks": (city_blocks, None),
}
