import json
import sqlite3
import struct

from pyspark.sql import functions as F

from terralex.operators import graph, planar
from terralex.plans import spatial_queries
from terralex.sources import maps, pages, sinks


def lattice(spark, n=3, step=100.0):
    rows, k = [], 0
    for i in range(n):
        for line in ([(0.0, i * step), ((n - 1) * step, i * step)], [(i * step, 0.0), (i * step, (n - 1) * step)]):
            rows += [(k, f"rue {k}", p, x, y) for p, (x, y) in enumerate(line)]
            k += 1
    rows += [(k, "rue 0", 0, 150.0, 0.0), (k, "rue 0", 1, 150.0, 40.0)]  # a dead end
    return planar.segments_of(spark.createDataFrame(rows, "line long, name string, pos int, x double, y double"), "line", "pos", "name", "x", "y")


def test_lattice_has_its_blocks(spark):
    pieces = planar.noded(lattice(spark))
    assert pieces.count() == 14
    nodes = {p for r in pieces.collect() for p in ((r.ax, r.ay), (r.bx, r.by))}
    edges = planar.street_edges(planar.planarized(lattice(spark)))
    table = {r.name: r for r in planar.edge_table(edges, 48.86).collect()}
    assert len(nodes) == 11 and len(table) == 6 and sorted(r.edge for r in table.values()) == list(range(6))
    assert all(len(r.crossings) == 3 for r in table.values())
    blocks = planar.faces(edges).collect()
    assert sorted(round(b.area) for b in blocks) == [10_000] * 4
    assert all(len(b.edges) == 4 for b in blocks) and sorted(len(b.ring) for b in blocks) == [4, 4, 4, 5]


def test_near_touch_and_snap(spark):
    rows = [(0, "a", 0, 0.0, 0.0), (0, "a", 1, 100.0, 0.0), (1, "b", 0, 50.0, 2.0), (1, "b", 1, 50.0, 80.0)]
    lines = planar.segments_of(spark.createDataFrame(rows, "line long, name string, pos int, x double, y double"), "line", "pos", "name", "x", "y")
    links = planar.near_touches(planar.noded(lines)).collect()
    assert [(r.p_name, r.q_name, r.x, r.y) for r in links] == [("a", "b", 50.0, 1.0)]
    joined = planar.noded(planar.connected(planar.noded(lines)))
    assert planar.junctions(joined).count() == 1
    near = [(0, "a", 0, 0.0, 0.0), (0, "a", 1, 100.0, 0.0), (1, "b", 0, 50.0, 0.0), (1, "b", 1, 50.0, 80.0), (2, "c", 0, 54.0, 0.0), (2, "c", 1, 54.0, -80.0)]
    lines = planar.segments_of(spark.createDataFrame(near, "line long, name string, pos int, x double, y double"), "line", "pos", "name", "x", "y")
    moved = planar.noded(planar.snapped(planar.noded(lines)))
    assert [(r.x, r.y) for r in planar.junctions(moved).collect()] == [(52.0, 0.0)]


def test_street_queries_read_all_points(spark):
    sf = "/root/testdata/sf0.01"
    ids = [r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()]
    assert max(ids) > 160
    lines = {r.line for r in spatial_queries._streets(spark, sf).select("line").distinct().collect()}
    assert lines == {i // 4 for i in ids}
    named = {r.name for r in spatial_queries.street_graph(spark, sf).collect()}
    # all but a few streets hang together
    assert named <= {f"rue {k}" for k in lines} and len(named) > 0.95 * len(lines)


def test_rings():
    assert planar.stitched([[(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 1)], [(0, 0), (0, 1)]]) == [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    assert planar.stitched([[(0, 0), (1, 0)], [(5, 5), (6, 6)]]) == [(0, 0), (1, 0)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    assert graph.components(edges.where("a < 0")).count() == 0


def test_extract_and_scripts(spark, tmp_path):
    doc = {"elements": [{"type": "node", "id": 1, "lat": 48.1, "lon": 2.1}, {"type": "way", "id": 9, "nodes": [1, 2], "tags": {"name": "Rue É", "highway": "service"}}, {"type": "way", "id": 8, "center": {"lat": 1.0, "lon": 2.0}}, {"type": "relation", "id": 3, "tags": {"name": "X"}, "members": [{"type": "way", "role": "outer", "geometry": [{"lat": 0, "lon": 1}, {"lat": 2, "lon": 3}]}, {"type": "way", "role": "inner"}]}]}
    (tmp_path / "raw.json").write_text(json.dumps(doc, indent=1))
    found = maps.elements(spark, str(tmp_path / "raw.json"))
    assert [(r.node, r.lat) for r in maps.nodes(found).collect()] == [(1, 48.1)]
    assert [(r.way, r.name, r.pos, r.node) for r in maps.ways(found).collect()] == [(9, "Rue É", 0, 1), (9, "Rue É", 1, 2)]
    assert maps.located(found).count() == 2
    assert [[tuple(p) for p in s] for s in maps.outer_parts(found).first().parts] == [[(1.0, 0.0), (3.0, 2.0)]]
    rows = spark.createDataFrame([(2, "é"), (1, "a;b")], "k int, t string")
    sinks.write_script_json(rows, str(tmp_path / "out"), "window.X", ["k"])
    back = maps.script_json(spark, str(tmp_path / "out"), "array<struct<k:int,t:string>>", "window.X=")
    assert [tuple(r) for r in back.collect()] == [(1, "a;b"), (2, "é")]
    assert maps.optional(spark, str(tmp_path / "none.json"), "a int").count() == 0
    shape = {"features": [{"properties": {"l_qu": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}, {"properties": {"l_qu": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[5, 5], [6, 5], [6, 6]]], [[[8, 8], [9, 8], [9, 9]]]]}}]}
    (tmp_path / "q.geojson").write_text(json.dumps(shape))
    assert [(r.l_qu, len(r.rings)) for r in maps.geojson(spark, str(tmp_path / "q.geojson"), "l_qu: string").collect()] == [("A", 1), ("B", 2)]


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "x.gpkg")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('road', 'geom')")
    con.execute("CREATE TABLE road (fid INTEGER PRIMARY KEY, nature TEXT, geom BLOB)")
    line = struct.pack("<BII9d", 1, 1002, 3, 1, 2, 9, 3, 4, 9, 5, 6, 9)  # with heights
    multi = struct.pack("<BII", 1, 5, 2) + struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1) + struct.pack("<BII4d", 1, 2, 2, 7, 7, 8, 8)
    for i, shape in enumerate([line, multi, None]):
        con.execute("INSERT INTO road VALUES (?, ?, ?)", (i + 1, "Sentier", None if shape is None else b"GP\x00\x01" + struct.pack("<i", 2154) + shape))
    con.commit()
    con.close()
    rows = {r.fid: r for r in maps.layer(spark, path, "road", 2).collect()}
    assert [tuple(p) for p in rows[1].parts[0]] == [(1, 2), (3, 4), (5, 6)] and len(rows[2].parts) == 2 and rows[3].parts is None
    flat = maps.flattened(maps.layer(spark, path, "road"), "fid", "nature")
    assert flat.select("line").distinct().count() == 3 and flat.count() == 7


def test_pages(spark, tmp_path):
    (tmp_path / "a.htm").write_bytes("<html><script>x</script>Le Pont  Histoire de Paris\nLe Pont fut bâti\nen 1600. Mise à jour : hier</html>".encode("cp1252"))
    page = pages.archived(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in pages.panels(page, 5).collect()] == [("Le Pont", "fut bâti en 1600.")]
    made = spark.createDataFrame([("paris/p_liste.htm", '<a href="x.htm"><a href="liste2.htm"><a href="http://e/y.htm"><a href="paris/z.htm">'), ("paris/x.htm", "X"), ("paris/z.htm", "Z"), ("w.htm", "W")], "path string, html string")
    index = spark.createDataFrame([('<a href="paris/p_liste.htm">',)], "html string")
    assert sorted(r.path for r in pages.crawl(index, made).collect()) == ["paris/x.htm", "paris/z.htm"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("r", "k", 2), ("r", "k", 1), ("r", "l", 3)], "room string, key string, ts int")
    for _ in range(2):
        sinks.insert_new(rows, path, ["room", "key"], ["ts"])
    sinks.insert_new(spark.createDataFrame([("r", "k", 0), ("s", "k", 9)], rows.schema), path, ["room", "key"], ["ts"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("r", "k", 1), ("r", "l", 3), ("s", "k", 9)]
    sinks.swap(spark.read.parquet(path).withColumn("more", F.lit(1)), path)
    assert spark.read.parquet(path).columns == ["room", "key", "ts", "more"]


def test_insert_reads_its_keys_only(spark, tmp_path):
    """Batches after a cut-short one, over all folders of the index: each key once, and only the folders asked for read."""
    path = str(tmp_path / "t")
    batch = lambda a, b, tag: spark.range(a, b).select(F.col("id").alias("key"), F.lit(tag).alias("by"), F.col("id").alias("ts"))
    sinks.insert_new(batch(0, 300, "x"), path, ["key"], ["ts"])
    batch(300, 310, "cut short").write.mode("append").parquet(path)  # rows whose keys no index has
    sinks.insert_new(batch(250, 400, "y"), path, ["key"], ["ts"])
    sinks.insert_new(batch(0, 400, "z"), path, ["key"], ["ts"])
    got = {r.key: r.by for r in spark.read.parquet(path).collect()}
    assert spark.read.parquet(path).count() == 400 == len(got)
    assert all(got[k] == ("x" if k < 300 else "cut short" if k < 310 else "y") for k in got)
    one = sinks._index(spark, path, ["key"], spark.read.parquet(path).schema).where(F.col("part").isin([3]))
    assert 0 < one.count() < 30 and "PartitionFilters: [" in one._jdf.queryExecution().toString()
    sinks.insert_new(batch(0, 0, "none"), path, ["key"], ["ts"])
    assert spark.read.parquet(path).count() == 400


def test_plaque_export_and_stored_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"geo_point_2d": {"lat": 1.0, "lon": 2.0}, "titre": "É"}, {"x_4326": 3.0, "y_4326": 0, "titre": "none"}, {"x_4326": 3.0, "y_4326": 4.0}]))
    rows = maps.export_position(maps.plaques(spark, str(tmp_path / "p.json"))).collect()
    assert sorted((r.lat, r.lon) for r in rows) == [(1.0, 2.0), (4.0, 3.0)] and len({r.id for r in rows}) == 2
    assert maps.plaques(spark, str(tmp_path / "none.json")).count() == 0
    page = lambda t: f"<b>{t}</b> Histoire de Paris {t} fut bâti"
    crawled = spark.createDataFrame([("paris/a.htm", page("A"))], "path string, html string")
    stored = spark.createDataFrame([("paris/a.htm", page("old")), ("paris/b.htm", page("B")), ("paris/c_liste.htm", page("C"))], "path string, html string")
    assert sorted((r.path, r.title, r.text) for r in pages.mined(crawled, stored, 5).collect()) == [("paris/a.htm", "A", "fut bâti"), ("paris/b.htm", "B", "fut bâti")]
