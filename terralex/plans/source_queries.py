"""Round trips: rows of the supplied tables are written as the inputs that the sources read, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex.functions import geo
from terralex.functions import text as T
from terralex.operators import city, filters, planar
from terralex.plans.relational_queries import FOUND, discoveries
from terralex.plans.spatial_queries import POINTS, points
from terralex.plans.text_queries import read
from terralex.sources import maps, sinks
from terralex.staging import shared_dir, stage
from terralex.streaming import feed
from terralex.streaming.room import Room


def _home(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"


def _documents(rows: DataFrame, key: str, array: str, home: str) -> str:
    """One JSON document for each hundred keys, each in a file of its own; what to read."""
    grouped = rows.groupBy(F.expr(f"{key} div 100").alias("g")).agg(F.collect_list("e").alias(array))
    grouped.select("g", F.to_json(F.struct(array)).alias("value")).write.partitionBy("g").text(home)
    return f"{home}/*"


def extract_ways(spark, d):
    """A map extract of nodes and ways: each way's located nodes in order."""
    at = lambda f: (F.col(f) / 10 + 48.0)
    none = F.lit(None)
    node = F.struct(F.lit("node").alias("type"), F.col("vec_id").alias("id"), at("x").alias("lat"), at("y").alias("lon"), none.cast("array<long>").alias("nodes"), none.cast("map<string,string>").alias("tags"))
    tags = F.create_map(F.lit("name"), F.concat(F.lit("rue "), F.col("label")), F.lit("highway"), F.lit("service"))
    way = F.struct(F.lit("way").alias("type"), F.col("vec_id").alias("id"), none.cast("double").alias("lat"), none.cast("double").alias("lon"), F.array(F.col("vec_id") + 1, F.lit(-1).cast("long"), "vec_id").alias("nodes"), tags.alias("tags"))
    rows = points(spark, d).select("vec_id", F.explode(F.array(node, way)).alias("e"))
    found = stage(maps.elements(spark, _documents(rows, "vec_id", "elements", _home(spark, "extract"))), "extract")
    located = maps.ways(found).join(maps.nodes(found), "node")
    return located.groupBy("way", "name").agg(F.count("*").alias("n"), F.round(F.min_by("lat", "pos"), 9).alias("first_lat"))


EXTRACT_WAYS = f"""
WITH {POINTS}, w AS (SELECT vec_id AS way, 'rue ' || label AS name, vec_id + 1 AS node, 0 AS pos FROM p UNION ALL SELECT vec_id, 'rue ' || label, vec_id, 2 FROM p)
SELECT way, name, count(*)::BIGINT AS n, round(arg_min(x / 10 + 48.0, pos), 9) AS first_lat FROM w JOIN p ON p.vec_id = w.node GROUP BY way, name
"""


def extract_rings(spark, d):
    """Boundary relations whose outer ways come in pieces, stitched: size and area."""
    c = lambda i, j: F.struct((F.col("y") + j).alias("lat"), (F.col("x") + i).alias("lon"))
    member = lambda role, *ps: F.struct(F.lit("way").alias("type"), F.lit(role).alias("role"), F.array(*ps).alias("geometry"))
    parts = F.array(member("outer", c(0, 0), c(1, 0)), member("inner", c(5, 5), c(6, 6)), member("outer", c(0, 1), c(1, 1)), member("outer", c(0, 0), c(0, 1)), member("outer", c(1, 1), c(1, 0)))
    name = F.concat(F.lit("Paris "), F.col("vec_id"), F.when(F.col("vec_id") % 2 == 0, "e Arrondissement").otherwise(" ailleurs"))
    rows = points(spark, d).select("vec_id", F.struct(F.lit("relation").alias("type"), F.col("vec_id").alias("id"), F.create_map(F.lit("name"), name).alias("tags"), parts.alias("members")).alias("e"))
    found = maps.outer_parts(maps.elements(spark, _documents(rows, "vec_id", "elements", _home(spark, "relations"))))
    ring = planar.stitch_rings(F.col("parts"))
    return found.select("relation", T.district(F.col("name")).alias("label"), ring.alias("ring")).select("relation", "label", F.size("ring").alias("n"), F.round(geo.ring_area(F.col("ring")), 6).alias("area"))


EXTRACT_RINGS = "SELECT vec_id AS relation, CASE WHEN vec_id % 2 = 0 THEN vec_id::VARCHAR ELSE 'Paris ' || vec_id || ' ailleurs' END AS label, 5 AS n, 1.0::DOUBLE AS area FROM embeddings"


def geojson_areas(spark, d):
    """Polygons and multi-polygons: how many parts each has, and its largest shell's centre."""
    c = lambda i, j: F.array(F.round(F.col("x") + i, 6), F.round(F.col("y") + j, 6))
    ring = lambda s: F.array(c(0, 0), c(s, 0), c(s, s), c(0, s))
    many = F.col("vec_id") % 2 == 1
    shape = F.struct(F.when(many, "MultiPolygon").otherwise("Polygon").alias("type"), F.when(many, F.to_json(F.array(F.array(ring(1)), F.array(ring(2))))).otherwise(F.to_json(F.array(ring(3)))).alias("coordinates"))
    rows = points(spark, d).select("vec_id", F.struct(F.struct(F.col("vec_id").cast("string").alias("l_qu")).alias("properties"), shape.alias("geometry")).alias("e"))
    found = maps.geojson(spark, _documents(rows, "vec_id", "features", _home(spark, "geojson")), "l_qu: string")
    shells = F.transform("rings", lambda rings: F.get(rings, F.lit(0)))
    measured = found.select("l_qu", F.size("rings").alias("n"), geo.largest_ring(shells).alias("ring")).withColumn("c", geo.ring_centre(F.col("ring")))
    return measured.select("l_qu", "n", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"), F.round(geo.ring_area(F.col("ring")), 4).alias("area"))


GEOJSON_AREAS = f"""
WITH {POINTS}, s AS (SELECT vec_id::VARCHAR AS l_qu, round(x, 6) AS x, round(y, 6) AS y, CASE WHEN vec_id % 2 = 1 THEN 2 ELSE 3 END AS s, CASE WHEN vec_id % 2 = 1 THEN 2 ELSE 1 END AS n FROM p)
SELECT l_qu, n, round(x + s / 2, 6) AS cx, round(y + s / 2, 6) AS cy, (s * s)::DOUBLE AS area FROM s
"""


def script_rows(spark, d):
    """A table behind a script's assignment, written and read again."""
    home = _home(spark, "script")
    sinks.write_script_json(read(spark, d, "nation"), home, "window.NATIONS", ["n_nationkey"])
    return maps.script_json(spark, home, "array<struct<n_nationkey:int,n_name:string,n_regionkey:int>>", "window.NATIONS=")


SCRIPT_ROWS = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def work_list(spark, d):
    """Suppliers as a tab-separated work list, written and read again."""
    home = _home(spark, "list")
    rows = read(spark, d, "supplier")
    sinks.write_work_list(rows.select(T.slug(F.col("s_name")).alias("key"), T.image_url("https://example.org/", F.when(F.col("s_suppkey") % 2 == 0, F.lit("https://a/b")).otherwise(""), F.col("s_name")).alias("url")), home)
    return spark.read.option("sep", "\t").schema("key string, url string").csv(home)


WORK_LIST = """
SELECT regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g') AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'https://a/b' ELSE 'https://example.org/' || replace(s_name, '#', '%23') END AS url FROM supplier
"""


def board_list(spark, d):
    """Boards of a map extract, some placed by their centre, some nowhere: the city's own ones with a picture."""
    k = F.col("s_suppkey")
    place = lambda shown, v: F.when(shown, F.lit(v))
    tags = F.map_concat(
        F.create_map(F.lit("board:title"), F.concat(F.lit("Panneau "), k), F.lit("inscription"), F.lit("un -\nmot"), F.lit("inscription:3"), F.lit(" suite ")),
        F.when(k % 2 == 0, F.create_map(F.lit("operator"), F.lit("Ville de Paris"))).otherwise(F.create_map(F.lit("operator"), F.lit("x"))), F.when(k % 3 > 0, F.create_map(F.lit("image"), F.lit("https://i"))).otherwise(F.create_map(F.lit("image"), F.lit(""))),
    )
    centre = F.when(k % 5 < 2, F.struct(F.lit(48.5).alias("lat"), F.lit(2.5).alias("lon")))
    rows = read(spark, d, "supplier").select("s_suppkey", F.struct(F.lit("node").alias("type"), k.alias("id"), place(k % 5 > 2, 48.25).alias("lat"), place(k % 5 > 2, 2.25).alias("lon"), centre.alias("center"), tags.alias("tags")).alias("e"))
    found = city.boards(maps.elements(spark, _documents(rows, "s_suppkey", "elements", _home(spark, "boards"))))
    return found.where(F.col("history") & filters.with_picture(F.col("commons"), F.col("image"))).select("osm", "lat", "lon", "title", "text")


BOARD_LIST = r"""
SELECT 'node/' || s_suppkey AS osm, CASE WHEN s_suppkey % 5 > 2 THEN 48.25 ELSE 48.5 END::DOUBLE AS lat, CASE WHEN s_suppkey % 5 > 2 THEN 2.25 ELSE 2.5 END::DOUBLE AS lon, 'Panneau ' || s_suppkey AS title, 'un -' || chr(10) || 'mot' || chr(10) || 'suite' AS text
FROM supplier WHERE s_suppkey % 5 <> 2 AND s_suppkey % 2 = 0 AND s_suppkey % 3 > 0
"""


def plaque_positions(spark, d):
    """Places of an export's rows: a point, else a pair without zeros; rows without are left out."""
    k = F.col("p_partkey")
    rows = read(spark, d, "part").select("p_partkey", F.when(k % 3 == 0, F.struct((k / 7).alias("lat"), (k / 9).alias("lon"))).alias("geo_point_2d"), F.when(k % 5 > 0, k / 11).alias("x_4326"), F.when(k % 4 > 0, k / 13).otherwise(0.0).alias("y_4326"))
    return maps.export_position(rows).select("p_partkey", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


PLAQUE_POSITIONS = """
SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN p_partkey / 7 ELSE p_partkey / 13 END, 9) AS lat, round(CASE WHEN p_partkey % 3 = 0 THEN p_partkey / 9 ELSE p_partkey / 11 END, 9) AS lon
FROM part WHERE p_partkey % 3 = 0 OR (p_partkey % 5 > 0 AND p_partkey % 4 > 0)
"""


def cycle_rescue(spark, d):
    """Cycleways that are streets of their own: called like one, and no road has their name or one within an edit."""
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 3 == 0, "Piste ").otherwise("Rue "), F.when(k % 10 > 1, F.concat(F.lit("N"), k % 977 * 37)).otherwise(F.concat(F.lit("N"), k % 977 * 370)))
    rows = read(spark, d, "customer").select("c_custkey", name.alias("name"), F.when(k % 4 == 0, "cycleway").otherwise("service").alias("highway"), F.lit(None).cast("string").alias("footway"))
    return filters.street_ways(rows).where("highway = 'cycleway'").select("c_custkey", "name")


CYCLE_RESCUE = """
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Piste ' ELSE 'Rue ' END || 'N' || (CASE WHEN c_custkey % 10 > 1 THEN c_custkey % 977 * 37 ELSE c_custkey % 977 * 370 END) AS name, c_custkey % 4 = 0 AS cycle FROM customer),
k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key FROM r), roads AS (SELECT DISTINCT name, key FROM k WHERE NOT cycle)
SELECT c_custkey, name FROM k WHERE cycle AND name LIKE 'Rue %' AND name NOT IN (SELECT name FROM roads) AND NOT EXISTS (SELECT 1 FROM roads WHERE damerau_levenshtein(roads.key, k.key) <= 1)
"""


def export_cleaned(spark, d):
    """Texts with spreadsheet escapes and notes put in, cleaned."""
    text = F.concat(F.lit("_x008E_"), F.replace(F.col("text"), F.lit("e "), F.lit("e_x00E9_ [sic] ")), F.lit("_x0041_[ Italique : |fin/ ]\u0090[été] "))
    return read(spark, d, "documents").select("doc_id", F.md5(T.clean_export(text)).alias("text_md5"))


EXPORT_CLEANED = r"""
WITH t AS (SELECT doc_id, 'Ž' || replace(regexp_replace(regexp_replace(replace(text, 'e ', 'e' || chr(1) || ' [sic] '), '_x[0-9A-Fa-f]{4}_', ' ', 'g'), '\[[^\]]*\]', ' ', 'g'), chr(1), 'é') || '  fin ' AS text FROM documents)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[|│/_*<>±\[\]\x00-\x1f\x7f-\x9f]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'))) AS text_md5 FROM t
"""


def room_codes(spark, d):
    return read(spark, d, "part").select("p_partkey", filters.room_code(F.concat(F.lit(" "), F.substring("p_name", 1, 4), F.col("p_size"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(""))).alias("code"))


ROOM_CODES = "SELECT p_partkey, CASE WHEN regexp_matches(c, '^[A-Z0-9]{1,12}$') THEN c END AS code FROM (SELECT p_partkey, upper(trim(' ' || substr(p_name, 1, 4) || p_size || CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END)) AS c FROM part)"


def _feed_files(spark, d) -> str:
    home = _home(spark, "room")
    discoveries(spark, d).drop("event_id").write.parquet(home)
    return home


def room_live(spark, d):
    """One room's rows of a stream, as they come."""
    home = _feed_files(spark, d)
    query = feed.live(feed.feed(spark, home), "CLICK").writeStream.format("parquet").option("path", f"{home}.out").option("checkpointLocation", f"{home}.state").trigger(availableNow=True).start()
    feed.finish(query, 600)
    return spark.read.schema(f"{feed.FOUND}, live BOOLEAN").parquet(f"{home}.out").groupBy("key", "live").agg(F.count("*").alias("n"))


ROOM_LIVE = f"WITH {FOUND} SELECT key, true AS live, count(*)::BIGINT AS n FROM f WHERE room = 'CLICK' GROUP BY key"


def room_history(spark, d):
    """What a player who joins a room finds: each key once, from the history or the stream."""
    home, target = _feed_files(spark, d), _home(spark, "found")
    # the history's pages go by key, so a key's rows are one
    stage(spark.read.parquet(home).dropDuplicates(["room", "key"]), "room").write.parquet(f"{home}.once")
    room = Room(spark, f"{home}.once", lambda rows, live: rows.select("room", "key").write.mode("append").parquet(target), page=2000)
    if not room.join(" click ", availableNow=True):
        raise RuntimeError("the room was not joined")
    room.query.awaitTermination()
    room.leave()
    return spark.read.parquet(target).distinct()


ROOM_HISTORY = f"WITH {FOUND} SELECT DISTINCT room, key FROM f WHERE room = 'CLICK'"

ALL = {
    "extract_ways": (extract_ways, EXTRACT_WAYS),
    "extract_rings": (extract_rings, EXTRACT_RINGS),
    "geojson_areas": (geojson_areas, GEOJSON_AREAS),
    "script_rows": (script_rows, SCRIPT_ROWS),
    "work_list": (work_list, WORK_LIST),
    "board_list": (board_list, BOARD_LIST),
    "plaque_positions": (plaque_positions, PLAQUE_POSITIONS),
    "cycle_rescue": (cycle_rescue, CYCLE_RESCUE),
    "export_cleaned": (export_cleaned, EXPORT_CLEANED),
    "room_codes": (room_codes, ROOM_CODES),
    "room_live": (room_live, ROOM_LIVE),
    "room_history": (room_history, ROOM_HISTORY),
}
