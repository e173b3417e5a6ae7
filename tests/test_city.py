"""Whole builds against plain second versions over the registered queries' own tables."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terralex.functions import fixed, geo
from terralex.functions import text as T
from terralex.operators import city, planar
from terralex.plans import city_queries, spatial_queries
from terralex.staging import stage

SF = "/root/testdata/sf0.001"


def osa(a, b):
    table = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i * j == 0}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                table[i, j] = min(table[i, j], table[i - 2, j - 2] + 1)
    return table[len(a), len(b)]


def test_osa_by_batch(spark):
    words = ["", "a", "ab", "ba", "abc", "ca", "cartoux", "catroux", "blue widget", "bleu wigdet", "é🙂x", "x🙂é", "q" * 40]
    df = spark.createDataFrame([(a, b) for a in words for b in words] + [(None, "a"), ("a", None)], "a string, b string")
    for r in df.select("a", "b", T.osa(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == (None if r.a is None or r.b is None else osa(r.a, r.b)), r
    assert all(T.osa_distance(a, b) == osa(a, b) for a in words for b in words)


def test_search_by_both_keys(spark):
    from terralex.operators import fuzzy

    kinds = ("Rue de la", "Place du", "Porte", "Rue Saint")
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    first = {}
    for r in sorted(parts, key=lambda r: r.p_partkey):
        first.setdefault(f"{kinds[r.p_partkey % 4]} {r.p_name}", r.p_partkey)
    keys = {n: [k for k in dict.fromkeys([T.core_name(n), T.core_name(n, False)]) if k] for n in first}
    wanted = T.core_name("porte blue widgit", False)
    want = sorted((min(osa(wanted, k) for k in ks), len(",".join(ks)), first[n], n) for n, ks in keys.items())[:60]
    got = city_queries.search_keys(spark, SF).collect()
    assert [(r.distance, r.name, r["keys"]) for r in got] == [(d, n, ",".join(keys[n])) for d, _, _, n in want]
    assert all(r.grade == ("ok" if r.distance < 2 else "near" if r.distance == 2 else "no") for r in got)
    odd = spark.createDataFrame([("Rue de la Porte Jaune", 3), ("porte jaune", 1), ("Porte Jaune", 2), ("---", 0), (None, 4), ("porte jaune", 9)], "n string, i long")
    found = fuzzy.search_keys(fuzzy.street_keys(odd, "n", "i"), "porte jaune")
    assert [(r.name, r.distance) for r in found.collect()] == [("porte jaune", 0), ("Porte Jaune", 0), ("Rue de la Porte Jaune", 0)]  # ties: length of keys, then first seen
    assert fuzzy.search_keys(fuzzy.street_keys(odd, "n", "i"), "-é-").count() == 0
    assert [r.name for r in fuzzy.search_keys(fuzzy.street_keys(odd, "n", "i"), "rue de la porte jaune", 1).collect()] == ["Rue de la Porte Jaune"]


def on_segment(px, py, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / square)) if square else 0.0
    return math.hypot(px - ax - t * dx, py - ay - t * dy)


def in_ring(x, y, ring):
    return sum(((a[1] > y) != (b[1] > y)) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1


def cross(p, q):
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = *p, *q
    side = lambda x, y, u, v, s, t: (u - x) * (t - y) - (v - y) * (s - x)
    return side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) <= 0 and side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) <= 0


def test_street_register(spark):
    roads, ways, nodes, commune = (df.collect() for df in city_queries.register_inputs(spark, SF))
    shell = [(p.x, p.y) for p in commune[0].shell]
    legs = lambda line: list(zip(line, line[1:]))
    kept = {}
    for r in roads:
        line = [(p.x, p.y) for p in r.parts[0]]
        if r.nature in fixed.ROAD_KINDS and (any(in_ring(*p, shell) for p in line) or any(cross(s, side) for s in legs(line) for side in zip(shell, shell[1:] + shell[:1]))):
            official = next((n for n in (r.ban_left, r.ban_right, r.route_name) if n is not None), None)
            note = T.expanded(r.note_left) if r.note_left else None
            kept[r.road] = (line, official if official is not None else note, "official" if official is not None else "note" if note else "map")
    key = lambda n: "".join(c for c in n.lower().replace("é", "e") if c.isalnum())
    known = {key(n) for _, n, _ in kept.values() if n and n.strip()}
    place = {n.node: (n.x, n.y) for n in nodes}
    lines = defaultdict(list)
    for w in ways:
        if w.node in place and w.highway != "steps" and key(w.name) in known:
            lines[w.way, w.name].append((w.pos, place[w.node]))
    streets = defaultdict(list)
    for (_, name), points in lines.items():
        streets[name] += legs([p for _, p in sorted(points)])
    want = {}
    for road, (line, name, origin) in kept.items():
        if name is None:
            points = []
            for (ax, ay), (bx, by) in legs(line):
                n = math.ceil(math.hypot(bx - ax, by - ay))
                points += [(ax + (bx - ax) * i / n, ay + (by - ay) * i / n) for i in range(n)]
            points.append(line[-1])
            best = []
            for street, segments in streets.items():
                if not segments or min(on_segment(*points[0], *a, *b) for a, b in segments) > 10:
                    continue
                far = [min(on_segment(*p, *a, *b) for a, b in segments) for p in points]
                if max(far) <= 10 and sum(far) / len(far) <= 2:
                    best.append((sum(far) / len(far), street))
            name = min(best)[1] if best else None
        if name and "/" not in name:
            want[road] = (name, origin)
    got = {r.road: (r.name, r.origin) for r in city_queries.street_register(spark, SF).collect()}
    assert got == want and {o for _, o in got.values()} == {"official", "note", "map"}
    table = city.register_lines(city.street_register(*city_queries.register_inputs(spark, SF)))
    assert table.count() == 2 * len(want) and set(table.columns) == {"line", "name", "ax", "ay", "bx", "by"}


def test_clip_by_a_crossing_alone(spark):
    ring = [{"x": x, "y": y} for x, y in [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
    areas = spark.createDataFrame([(0, ring, [])], f"area_idx int, shell {city_queries.SHAPE}, holes array<{city_queries.SHAPE}>")
    line = lambda *ps: [[{"x": x, "y": y} for x, y in ps]]
    rows = [(1, line((-5.0, 5.0), (15.0, 5.0))), (2, line((-5.0, 5.0), (-1.0, 5.0))), (3, line((2.0, 2.0), (3.0, 3.0))), (4, line((10.0, 20.0), (10.0, 10.0))), (5, line((50.0, 0.0), (0.0, 50.0)))]
    df = spark.createDataFrame(rows, f"road long, parts array<{city_queries.SHAPE}>")
    assert sorted(r.road for r in city.clipped(df, "road", areas, 4.0).collect()) == [1, 3, 4]


@pytest.fixture(scope="module")
def town(spark):
    """(edges, pieces, faces) of the queries' street town, made once."""
    edges = planar.street_edges(planar.planarized(spatial_queries._streets(spark, SF)))
    return edges, edges.collect(), stage(planar.faces(edges), "town-faces")


def test_street_graph_and_blocks(spark, town):
    """Pieces only meet in their ends; streets, crossings and lengths by plain sums; blocks by a walk over turns."""
    edges, pieces, made = town
    ends = lambda p: ((p.ax, p.ay), (p.bx, p.by))
    across = sorted(pieces, key=lambda p: min(p.ax, p.bx))
    for i, p in enumerate(across):
        for q in across[i + 1 :]:
            if min(q.ax, q.bx) > max(p.ax, p.bx):
                break
            if max(p.ay, p.by) >= min(q.ay, q.by) and max(q.ay, q.by) >= min(p.ay, p.by) and cross(ends(p), ends(q)):
                assert {p.a, p.b} & {q.a, q.b} or min(on_segment(*e, *q_[0], *q_[1]) for e, q_ in [(e, ends(q)) for e in ends(p)] + [(e, ends(p)) for e in ends(q)]) < 0.005, (p, q)
    uses = defaultdict(set)
    for p in pieces:
        uses[p.a].add(p.edge)
        uses[p.b].add(p.edge)
    crossings = defaultdict(set)
    for node, own in uses.items():
        if len(own) > 1:
            for e in own:
                crossings[e].add(node)
    degree = math.pi / 180

    def metres(p):
        lat = [y / geo.METRES_PER_DEGREE * degree for y in (p.ay, p.by)]
        lon = [x / (math.cos(spatial_queries.LAT0 * degree) * geo.METRES_PER_DEGREE) * degree for x in (p.ax, p.bx)]
        h = math.sin((lat[1] - lat[0]) / 2) ** 2 + math.cos(lat[0]) * math.cos(lat[1]) * math.sin((lon[1] - lon[0]) / 2) ** 2
        return 2 * geo.EARTH_M * math.asin(math.sqrt(h))

    km = defaultdict(float)
    for p in pieces:
        km[p.edge] += metres(p) / 1000
    table = {r.edge: r for r in planar.edge_table(edges, spatial_queries.LAT0).select("edge", "km", F.size("crossings").alias("n_crossings")).collect()}
    assert set(table) == set(km) == set(range(len(km)))
    assert all(abs(table[e].km - km[e]) <= 0.00051 and table[e].n_crossings == len(crossings[e]) for e in km)
    # blocks: without dead ends and bridges, then turn left-most at every node
    around = defaultdict(list)
    for p in pieces:
        around[p.a].append((math.atan2(p.by - p.ay, p.bx - p.ax), p.b))
        around[p.b].append((math.atan2(p.ay - p.by, p.ax - p.bx), p.a))
    at = {n: xy for p in pieces for n, xy in zip((p.a, p.b), ends(p))}

    def faces(around):
        turns = {n: [v for _, v in sorted(own)] for n, own in around.items()}
        out, seen = [], set()
        for n in turns:
            for v in turns[n]:
                face, half = [], (n, v)
                while half not in seen:
                    seen.add(half)
                    face.append(half)
                    own = turns[half[1]]
                    half = (half[1], own[own.index(half[0]) - 1])
                if face:
                    out.append(face)
        return out

    of = {h: i for i, face in enumerate(faces(around)) for h in face}
    bounding = {h for h in of if of[h] != of[h[1], h[0]]}
    kept = {n: [(a, v) for a, v in own if (n, v) in bounding] for n, own in around.items()}
    area = lambda face: sum(at[a][0] * at[b][1] - at[b][0] * at[a][1] for a, b in face) / 2
    traced = [f for f in faces({n: own for n, own in kept.items() if own})]
    inner = {min(f): area(f) for f in traced if area(f) > 0}
    holes = [(f, area(f)) for f in traced if area(f) < 0]
    nets = {}
    for n in kept:
        if kept[n] and n not in nets:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in nets:
                    nets[x] = n
                    todo += [v for _, v in kept[x]]
    by_start = {min(f): f for f in traced}
    for hole, lost in holes:
        x, y = min(at[a] for a, _ in hole)
        inside = [(inner[s], s) for s in inner if nets[s[0]] != nets[hole[0][0]] and in_ring(x, y, [at[a] for a, _ in by_start[s]])]
        if inside:
            inner[min(inside)[1]] += lost
    got = {(r.a, r.b): r.area for r in made.select("face.*", "area").collect()}
    assert set(got) <= set(inner) and all(abs(got[k] - inner[k]) <= 0.01 for k in got)
    # a block without a street along more than four metres of it is left out
    piece = {frozenset((p.a, p.b)): p for p in pieces}
    for k in set(inner) - set(got):
        along = Counter()
        for h in by_start[k]:
            p = piece[frozenset(h)]
            along[p.edge] += math.hypot(p.bx - p.ax, p.by - p.ay)
        assert max(along.values()) <= 4.0 + 1e-9


def test_street_export(spark, town):
    """Paths hold every piece once, break only where other than two pieces meet, and keep their shape within a tolerance."""
    edges, pieces, _ = town
    own = defaultdict(list)
    for p in pieces:
        own[p.edge].append(p)
    chains = {e: city._chains(sorted((p.asDict() for p in ps), key=lambda r: (r["a"], r["b"]))) for e, ps in own.items()}
    for e, ps in own.items():
        legs = Counter(frozenset(((a["x"], a["y"]), (b["x"], b["y"]))) for path in chains[e] for a, b in zip(path, path[1:]))
        assert legs == Counter(frozenset(((p.ax, p.ay), (p.bx, p.by))) for p in ps)
        degree = Counter(n for p in ps for n in ((p.ax, p.ay), (p.bx, p.by)))
        for path in chains[e]:
            assert all(degree[p["x"], p["y"]] == 2 for p in path[1:-1])
        odd = sum(1 for d in degree.values() if d % 2)
        assert len(chains[e]) >= max(1, odd // 2)
    shells = [[(x * 4000, y * 4000) for x, y in r] for _, r in spatial_queries.AREAS]
    hole = [(x * 4000, y * 4000) for x, y in spatial_queries.HOLE]
    areas = city_queries._areas(spark, 4000.0).drop("label")
    made = city.street_export(edges, areas, spatial_queries.LAT0).select("edge", F.size("paths").alias("n_paths"), F.size(F.flatten("paths")).alias("n_points"), "area")
    rows = {r.edge: r for r in made.collect()}
    assert set(rows) == set(own)
    for e, r in rows.items():
        simple = [geo.simplified_line([(p["x"], p["y"]) for p in path], 2.2) for path in chains[e]]
        assert (r.n_paths, r.n_points) == (len(simple), sum(map(len, simple)))
        x, y = simple[0][len(simple[0]) // 2]
        assert r.area == next((i for i, s in enumerate(shells) if in_ring(x, y, s) and not (i == 2 and in_ring(x, y, hole))), -1)


def test_block_rings(spark, town):
    *_, made = town
    faces = {(r.face.a, r.face.b): r for r in made.collect()}
    got = {(r.face.a, r.face.b): r for r in city.block_rings(made, 1.3, 3).collect()}
    for k, f in faces.items():
        line = [(p.x, p.y) for p in f.ring]
        want = simplified(line + line[:1], 1.3)[:-1]
        assert (k in got) == (len(want) >= 3)
        if k in got:
            assert [(p.x, p.y) for p in got[k].ring] == [(round(x, 3), round(y, 3)) for x, y in want] and got[k].edges == f.edges
            assert (got[k].centre.x, got[k].centre.y) == pytest.approx((sum(x for x, _ in want) / len(want), sum(y for _, y in want) / len(want)))


def simplified(points, eps):
    """The textbook recursion."""
    if len(points) < 3:
        return points
    far = [on_segment(*p, *points[0], *points[-1]) for p in points[1:-1]]
    if max(far) <= eps:
        return [points[0], points[-1]]
    at = far.index(max(far)) + 1
    return simplified(points[: at + 1], eps)[:-1] + simplified(points[at:], eps)


def test_paths_simplified(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").collect()
    walks = defaultdict(list)
    wide = math.cos(math.radians(spatial_queries.LAT0)) * geo.METRES_PER_DEGREE
    for e in sorted(events, key=lambda e: (e.ts, e.event_id)):
        walks[e.user_id].append(((e.event_id % 100 / 1000 + 2.3) * wide, (e.value / 1000 + 48.8) * geo.METRES_PER_DEGREE))
    got = {r.user_id: (r.n, r.n_kept) for r in spatial_queries.path_simplified(spark, SF).collect()}
    assert got == {u: (len(w), len(simplified(w, 2000.0))) for u, w in walks.items()}


def test_plaques(spark):
    export, segments = city_queries.plaque_inputs(spark, SF)
    lines = [(s.line_id, s.ax, s.ay, s.bx, s.by) for s in segments.collect()]
    want = {}
    for r in export.collect():
        if r.geo_point_2d:
            lat, lon = r.geo_point_2d.lat, r.geo_point_2d.lon
        elif r.x_4326 and r.y_4326:
            lat, lon = r.y_4326, r.x_4326
        else:
            continue
        t, body, a = (T.cleaned_export(x or "") for x in (r.titre, r.retranscription, r.adresse))
        if t or body:
            shouted = sum(c.isupper() for c in body) > 0.7 * sum(c.isalpha() for c in body)
            want[r.id] = (round(lat, 5), round(lon, 5), t, body.lower() if shouted else body, a, min((on_segment(lon, lat, *s[1:]), s[0]) for s in lines)[1])
    got = {r.id: (r.la, r.lo, r.t, r.r, r.a, r.ei) for r in city.plaques(export, segments, 0.02).collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        g = got[i]
        assert (g[2], g[4], g[5]) == (w[2], w[4], w[5]) and g[:2] == pytest.approx(w[:2])
        assert g[3].lower() == w[3].lower()
    assert {r.id for r in city_queries.plaque_build(spark, SF).collect()} == set(want)


def test_picture_bounds(spark):
    from terralex.functions import picture

    rows = [[0.1, 0.9, 0.9, 0.9, 0.1, 0.5, 0.5, 0.5, 0.5, 0.1], [0.0] * 10, [1.0] * 10, [0.9] + [0.1] * 9, [0.2, 0.2, 0.31, 0.31, 0.31, 0.31, 0.2, 0.2, 0.2, 0.2], [0.4] * 4 + [0.0] + [0.4] * 4]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, dark array<double>")
    got = {r.i: (r.b.x0, r.b.x1) for r in df.select("i", picture.panel_bounds(F.col("dark")).alias("b")).collect()}
    assert got == {0: (5, 9), 1: (0, 10), 2: (0, 10), 3: (0, 10), 4: (2, 6), 5: (0, 4)}


def test_boards_and_their_sources(spark, tmp_path):
    import json

    from terralex.sources import maps, sinks

    tags = lambda **t: {k.replace("__", ":"): v for k, v in t.items()}
    doc = [
        {"type": "node", "id": 1, "lat": 48.1234567, "lon": 2.0, "tags": tags(name="Histoire de Paris 1", inscription="cons-\ntruit", inscription__2=" ", inscription__3="en 1600", wikimedia_commons="File:A b.jpg;File:c.jpg")},
        {"type": "way", "id": 2, "center": {"lat": 48.2, "lon": 2.1}, "tags": tags(board__title="LE PONT. NEUF", operator="Ville de Paris", image="https://x/y.jpg")},
        {"type": "node", "id": 3, "lat": 48.3, "lon": 2.2, "tags": tags(name="Other", operator="Someone", image="z")},
        {"type": "node", "id": 4, "tags": tags(name="Histoire de Paris nowhere")},
        {"type": "relation", "id": 5, "tags": {"name": "Paris 2e Arrondissement"}, "members": [{"type": "way", "role": "outer", "geometry": [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}]}, {"type": "way", "role": "outer", "geometry": [{"lat": 0, "lon": 0}, {"lat": 1, "lon": 1}, {"lat": 0, "lon": 1}]}]},
        {"type": "relation", "id": 6, "tags": {"name": "Elsewhere"}, "members": [{"type": "way", "role": "outer", "geometry": [{"lat": 5, "lon": 5}, {"lat": 5, "lon": 6}]}]},
        {"type": "relation", "id": 7, "tags": {"name": "Paris 1er arrondissement"}, "members": [{"type": "way", "role": "outer", "geometry": [{"lat": 7, "lon": 7}, {"lat": 7, "lon": 8}]}]},
    ]
    (tmp_path / "raw.json").write_text(json.dumps({"elements": doc}))
    found = maps.elements(spark, str(tmp_path / "raw.json"))
    made = {r.osm: r for r in city.boards(found).collect()}
    assert {k: r.history for k, r in made.items()} == {"node/1": True, "way/2": True, "node/3": False}
    assert (made["node/1"].text, made["node/1"].lat, made["way/2"].title) == ("construit\nen 1600", 48.123457, "Le pont. neuf")
    stored = spark.createDataFrame([("way_9",)], "key string")
    fetch = city.pictures_to_fetch(city.boards(found), stored, "https://files/")
    assert sorted(map(tuple, fetch.collect())) == [("node_1", "https://files/A%20b.jpg"), ("way_2", "https://x/y.jpg")]
    sinks.write_work_list(fetch.where("key = 'way_2'"), str(tmp_path / "list"))
    assert spark.read.text(str(tmp_path / "list")).collect()[0][0] == "way_2\thttps://x/y.jpg"
    assert city.pictures_to_fetch(city.boards(found), fetch.select("key"), "x").count() == 0
    read = spark.createDataFrame([("way/2", " told by eye "), ("node/1", " ")], "osm string, text string")
    pages = spark.createDataFrame([("b", "Histoire de Paris 1", "second"), ("a", "histoire de PARIS 1", "first"), ("c", "", "none")], "path string, title string, text string")
    scans = spark.createDataFrame([("way/2", "told by")], "osm string, text string")
    sources = {r.id: (r.osm, r.vlm, r.rohee, r.ocr) for r in city.panel_sources(city.boards(found), read, pages, scans).collect()}
    assert sources == {"node/1": ("construit\nen 1600", None, "first", None), "way/2": (None, "told by eye", None, "told by")}
    segments = spark.createDataFrame([(7, 2.0, 48.0, 2.0, 48.15), (8, 2.1, 48.2, 2.3, 48.4)], "line_id long, ax double, ay double, bx double, by double")
    final = city.final_panels(city.panel_sources(city.boards(found), read, pages, scans), ["osm", "vlm", "rohee", "ocr"], "ocr", segments, 0.02)
    assert sorted((r.id, r.la, r.t, r.r, r.ei, r.src, r.conf) for r in final.collect()) == [("node/1", 48.12346, "Histoire de Paris 1", "construit\nen 1600", 7, "osm", "high"), ("way/2", 48.2, "Le pont. neuf", "told by eye", 8, "vlm", "high")]
    areas = {r.area_idx: (r.label, [tuple(p) for p in r.shell]) for r in city.district_areas(found).collect()}
    assert [areas[i][0] for i in range(3)] == ["1", "2", "Elsewhere"] and areas[1][1] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    ring = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    layer = spark.createDataFrame([("12e", [ring((0, 0), (1, 0), (1, 1)), ring((0, 0), (5, 0), (5, 5))]), ("Bois", [ring((0, 0), (1, 0), (1, 1))]), ("3e", [ring((2, 2), (3, 2), (3, 3))])], f"nom string, parts array<{city_queries.SHAPE}>")
    assert [(r.label, r.shell[1].x) for r in city.layer_areas(layer, "nom_officiel", "nom").orderBy("area_idx").collect()] == [("3", 3.0), ("12", 5.0), ("Bois", 1.0)]


def test_pictures_by_their_first_bytes(spark, tmp_path):
    from terralex.sources import maps

    for name, data in (("a.bin", b"\xff\xd8\xffx"), ("b.bin", b"\x89PNG\r"), ("c.bin", b"<html>"), ("d.bin", b"")):
        (tmp_path / name).write_bytes(data)
    assert sorted(r.path[-5:] for r in maps.images(spark, str(tmp_path)).select("path").collect()) == ["a.bin", "b.bin"]
    assert maps.first_file(spark, str(tmp_path), ".bin").endswith("a.bin")
