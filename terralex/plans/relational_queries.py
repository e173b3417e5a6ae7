"""Queries over rows in order, filters with a quarantine, feeds and tables of first writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex.operators import filters, graph, ordered
from terralex.sources import sinks
from terralex.staging import shared_dir, stage
from terralex.streaming import feed

KEY = "user_id || '|' || regexp_extract(props, '\"k\": *([0-9]+)', 1)"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def discoveries(spark, d) -> DataFrame:
    """Events as discoveries: the type is the room, user and property the key; some rows break a constraint."""
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1)
    return _read(spark, d, "events").select(
        F.upper(F.substring("event_type", 1, 12)).alias("room"), F.concat_ws("|", "user_id", k).alias("key"), F.col("event_type").alias("name"), (F.col("value") - 50).alias("la"), F.col("value").alias("lo"),
        F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).alias("by"), F.concat(F.lit("#"), F.lpad(F.hex("event_id"), 6, "0")).alias("color"), "ts", "event_id",
    )


FOUND = r"""f AS (SELECT upper(substr(event_type, 1, 12)) AS room, user_id || '|' || regexp_extract(props, '"k": *([0-9]+)', 1) AS key, event_type AS name, value - 50 AS la, value AS lo,
  CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR END AS by_, '#' || lpad(hex(event_id), 6, '0') AS color, ts, event_id FROM events)"""


def first_writer_wins(spark, d):
    return ordered.first_writers(discoveries(spark, d), ["room", "key"], ["ts", "event_id"]).select("room", "key", "event_id")


FIRST_WRITER_WINS = f"WITH {FOUND} SELECT room, key, arg_min(event_id, row(ts, event_id)) AS event_id FROM f GROUP BY room, key"


def constraint_quarantine(spark, d):
    rows = discoveries(spark, d)
    good, bad = filters.quarantined(rows, filters.constraint(*[F.col(c) for c in ("room", "key", "name", "la", "lo", "by", "color")]))
    return good.groupBy("room").agg(F.count("*").alias("n"), F.lit(True).alias("valid")).unionByName(bad.groupBy("room").agg(F.count("*").alias("n"), F.lit(False).alias("valid")))


CONSTRAINT_QUARANTINE = rf"""
WITH {FOUND}, v AS (SELECT room, coalesce(length(room) BETWEEN 1 AND 12 AND length(key) BETWEEN 1 AND 200 AND length(name) BETWEEN 1 AND 120 AND la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180
  AND (by_ IS NULL OR length(by_) <= 64) AND (color IS NULL OR regexp_matches(color, '^#[0-9a-fA-F]{{6}}$')), false) AS valid FROM f)
SELECT room, valid, count(*)::BIGINT AS n FROM v GROUP BY room, valid
"""


def keyset_page(spark, d):
    """The second page of a room's history."""
    rows = first_writer_wins(spark, d).where("room = 'CLICK'").select("key", "event_id")
    first = ordered.page_after(rows, "key", None, 500)
    return ordered.page_after(rows, "key", first.agg(F.max("key")).first()[0], 500)


KEYSET_PAGE = f"""
WITH {FOUND}, w AS (SELECT key, arg_min(event_id, row(ts, event_id)) AS event_id FROM f WHERE room = 'CLICK' GROUP BY key), a AS (SELECT max(key) AS last FROM (SELECT key FROM w ORDER BY key LIMIT 500))
SELECT key, event_id FROM w WHERE key > (SELECT last FROM a) ORDER BY key LIMIT 500
"""


def longest_run(spark, d):
    return ordered.longest_run(_read(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value") > 50)


LONGEST_RUN = """
WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
i AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS island FROM n WHERE value > 50),
r AS (SELECT user_id, min(pos) AS run_start, count(*)::BIGINT AS run_length FROM i GROUP BY user_id, island)
SELECT user_id, arg_min(run_start, row(-run_length, run_start)) AS run_start, max(run_length) AS run_length FROM r GROUP BY user_id
"""


def collapsed_types(spark, d):
    out = ordered.collapsed(_read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


COLLAPSED_TYPES = """
SELECT user_id, count(*)::BIGINT AS n FROM (SELECT user_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE i = 1 OR event_type IS DISTINCT FROM before GROUP BY user_id
"""


def splice_point(spark, d):
    lines = _read(spark, d, "lineitem")
    return ordered.splice_points(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_quantity", F.lit(60.0))


SPLICE_POINT = """
WITH r AS (SELECT l_orderkey, l_quantity, sum(l_quantity) OVER w AS reached, row_number() OVER w AS splice_pos FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)),
f AS (SELECT l_orderkey, min(splice_pos) AS splice_pos FROM r WHERE reached >= 60 GROUP BY 1)
SELECT f.l_orderkey, f.splice_pos::INTEGER AS splice_pos, reached - l_quantity AS before, reached FROM f JOIN r USING (l_orderkey, splice_pos)
"""


def last_rosters(spark, d):
    return ordered.last_states(_read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "value")


LAST_ROSTERS = "SELECT user_id, arg_max(event_type, row(ts, event_id)) AS event_type, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY user_id"


def bounded_queue(spark, d):
    return ordered.queue_order(discoveries(spark, d), ["room", "key"], "event_id", "lo", 500)


BOUNDED_QUEUE = f"""
WITH {FOUND} SELECT room, key, min(event_id) AS first_seq, arg_max(lo, event_id) AS lo FROM f GROUP BY room, key ORDER BY first_seq DESC LIMIT 500
"""


def road_filter(spark, d):
    """Orders as roads: the class, name and pavement filters together."""
    rows = _read(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 11 > 0, F.concat(F.lit("Voie "), F.col("o_custkey"), F.when(F.col("o_custkey") % 4 == 0, "/1").otherwise(""))).alias("name"),
        F.element_at(F.array(*[F.lit(x) for x in ("residential", "steps", "service", "cycleway")]), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("highway"),
        F.when(F.col("o_orderstatus") == "F", "sidewalk").alias("footway"),
    )
    return filters.street_ways(rows).select("o_orderkey", "name", "highway")


ROAD_FILTER = """
WITH r AS (SELECT o_orderkey, CASE WHEN o_custkey % 11 > 0 THEN 'Voie ' || o_custkey || CASE WHEN o_custkey % 4 = 0 THEN '/1' ELSE '' END END AS name,
  ['residential', 'steps', 'service', 'cycleway'][(o_orderkey % 4 + 1)::INTEGER] AS highway, CASE WHEN o_orderstatus = 'F' THEN 'sidewalk' END AS footway FROM orders)
SELECT o_orderkey, name, highway FROM r WHERE name <> '' AND coalesce(footway, '') <> 'sidewalk' AND NOT (name LIKE 'Voie %' AND name LIKE '%/%') AND highway NOT IN ('steps', 'cycleway')
"""


def name_precedence(spark, d):
    """First name that isn't null; empty ones and codes are dropped afterwards."""
    c = _read(spark, d, "customer")
    left, right = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), F.when(F.col("c_custkey") % 3 == 1, F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat(F.lit("Voie M/"), "c_custkey")))
    named = c.select("c_custkey", filters.precedence(left, right, F.col("c_mktsegment")).alias("name"))
    return named.where(filters.without_codes(F.col("name")))


NAME_PRECEDENCE = r"""
SELECT * FROM (SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 1 THEN CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Voie M/' || c_custkey END END, c_mktsegment) AS name FROM customer)
WHERE name <> '' AND NOT regexp_matches(name, '\b\w{1,3}/\d+\b')
"""


def existing_nodes(spark, d):
    """Each order's parts that are small, in order of the line."""
    lines = _read(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_suppkey").alias("pos"), "l_partkey")
    small = _read(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return filters.existing(lines, small, "l_orderkey", "pos", "l_partkey").select("l_orderkey", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("parts"))


EXISTING_NODES = """
SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_suppkey, l_partkey) AS parts FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size <= 25 GROUP BY 1
"""


def shared_junctions(spark, d):
    """Pairs of suppliers that meet in a part."""
    return graph.edge_neighbours(_read(spark, d, "lineitem"), "l_partkey", "l_suppkey")


SHARED_JUNCTIONS = "WITH e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT a.l_suppkey, count(DISTINCT b.l_suppkey)::BIGINT AS n_neighbours FROM e a JOIN e b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1"


def not_fetched(spark, d):
    """Documents without a label: a work list."""
    return sinks.missing(_read(spark, d, "documents").select("doc_id", "source"), _read(spark, d, "labels"), "doc_id")


NOT_FETCHED = "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


def source_counts(spark, d):
    docs = _read(spark, d, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 0).alias("with_text"), F.count_if(F.contains("text", F.lit("http"))).alias("with_link"), F.count_if(F.col("lang").isNull()).alias("unassigned"))


SOURCE_COUNTS = "SELECT source, count(*)::BIGINT AS n, count_if(length(text) > 0)::BIGINT AS with_text, count_if(contains(text, 'http'))::BIGINT AS with_link, count_if(lang IS NULL)::BIGINT AS unassigned FROM documents GROUP BY source"


def stream_upsert(spark, d):
    """The discovery feed as a stream of files, upserted in batches: the table it leaves."""
    base = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-feed-{uuid.uuid4().hex[:12]}"
    rows = stage(discoveries(spark, d).drop("event_id"), "feed")
    rows.repartitionByRange(4, "ts").write.parquet(f"{base}/in")
    query = feed.upsert(feed.valid(feed.feed(spark, f"{base}/in", files_per_trigger=1)), f"{base}/table", f"{base}/state")
    query.awaitTermination()
    return sinks.table(spark, f"{base}/table", feed.FOUND).select("room", "key")


STREAM_UPSERT = f"WITH {FOUND} SELECT DISTINCT room, key FROM f WHERE la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180"


def stream_first(spark, d):
    """The stream's own deduplication, as a stream that ends."""
    base = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-first-{uuid.uuid4().hex[:12]}"
    discoveries(spark, d).drop("event_id").write.parquet(f"{base}/in")
    query = feed.first_of_key(feed.feed(spark, f"{base}/in")).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(feed.FOUND).parquet(f"{base}/out").select("room", "key")


STREAM_FIRST = f"WITH {FOUND} SELECT DISTINCT room, key FROM f"


def history_and_live(spark, d):
    """A snapshot and the rows that came meanwhile, as one set."""
    rows = discoveries(spark, d).drop("event_id").where("room = 'CLICK'")
    return feed.with_history(rows.where("ts < TIMESTAMP '2024-01-20'"), rows.where("ts >= TIMESTAMP '2024-01-15'")).select("key", "live")


HISTORY_AND_LIVE = f"WITH {FOUND} SELECT key, min(ts) >= TIMESTAMP '2024-01-20' AS live FROM f WHERE room = 'CLICK' GROUP BY key"

ALL = {
    "first_writer_wins": (first_writer_wins, FIRST_WRITER_WINS),
    "constraint_quarantine": (constraint_quarantine, CONSTRAINT_QUARANTINE),
    "keyset_page": (keyset_page, KEYSET_PAGE),
    "longest_run": (longest_run, LONGEST_RUN),
    "collapsed_types": (collapsed_types, COLLAPSED_TYPES),
    "splice_point": (splice_point, SPLICE_POINT),
    "last_rosters": (last_rosters, LAST_ROSTERS),
    "bounded_queue": (bounded_queue, BOUNDED_QUEUE),
    "road_filter": (road_filter, ROAD_FILTER),
    "name_precedence": (name_precedence, NAME_PRECEDENCE),
    "existing_nodes": (existing_nodes, EXISTING_NODES),
    "shared_junctions": (shared_junctions, SHARED_JUNCTIONS),
    "not_fetched": (not_fetched, NOT_FETCHED),
    "source_counts": (source_counts, SOURCE_COUNTS),
    "stream_upsert": (stream_upsert, STREAM_UPSERT),
    "stream_first": (stream_first, STREAM_FIRST),
    "history_and_live": (history_and_live, HISTORY_AND_LIVE),
}
