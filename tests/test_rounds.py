"""Cases of the second round's findings, each on a small table."""

import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from terralex.operators import city, contract, graph, spatial


def _box(x, y, w, h):
    return [{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w, "y": y + h}, {"x": x, "y": y + h}]


def test_islands_of_equal_size(spark):
    """Envelopes that differ by rounding alone tie, and the first hole wins."""
    holes = [(1, _box(1.1, 0.7, 0.7, 1.1)), (2, _box(1.6, 0.5, 0.7, 1.1)), (3, _box(1.0, 0.6, 0.7, 1.1)), (4, _box(1.7, 0.8, 1.1, 0.7)), (5, _box(0.5, 0.5, 1.0, 1.5))]
    rows = spark.createDataFrame(holes, "hole long, ring array<struct<x:double,y:double>>").orderBy(F.desc("hole"))
    assert [r["hole"] for r in city.islands(rows, (1.0, 0.5), (3.0, 2.0), 3).collect()] == [1, 2, 3]


def _sets(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components_over_several_chunks(spark, monkeypatch):
    """Chunks of a few edges, all in one table or told apart by rounds, on nodes of three kinds."""
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(500)] + [(r.randrange(1000, 3000), r.randrange(1000, 3000)) for _ in range(1500)] + [(7, i) for i in range(4000, 5000)]
    edges = [e for e in edges if e[0] != e[1]]
    r.shuffle(edges)
    wanted = _sets(edges)
    numbers = spark.createDataFrame(edges, "a long, b long").repartition(3)
    kinds = {"n": F.col, "s": lambda c: F.concat(F.lit("é"), F.lpad(F.col(c).cast("string"), 6, "0")), "t": lambda c: F.struct(F.expr(f"{c} div 64").cast("double").alias("h"), F.struct((F.col(c) % 64).alias("l")).alias("g"))}
    told = {"n": lambda v: v, "s": lambda v: int(v[1:]), "t": lambda v: int(v["h"]) * 64 + v["g"]["l"]}
    for chunk in (None, 100):
        for kind, make in kinds.items():
            if chunk:
                monkeypatch.setattr(graph, "CHUNK", chunk)
            found = graph.components(numbers.select(make("a").alias("a"), make("b").alias("b")))
            rows = [(told[kind](x["node"]), told[kind](x["component"])) for x in found.collect()]
            assert len(rows) == len(wanted) and dict(rows) == wanted


def test_a_chunk_of_edges_becomes_stars(monkeypatch):
    """A chain that needed rounds of joins is told in one pass over its batches."""
    monkeypatch.setattr(contract, "CHUNK", 64)
    batches = [pa.RecordBatch.from_pylist([{"a": i, "b": i + 1} for i in range(s, s + 50)]) for s in range(0, 200, 50)]
    rows = [r for b in contract.contracted(iter(batches)) for r in b.to_pylist()]
    assert len(rows) == 200 and {r["b"] for r in rows} == {0, 64, 128, 192}
    assert list(contract.contracted(iter([]))) == []


def test_walks_match_lines_without_meeting_all(spark, monkeypatch):
    """Single segments are searched in boxes, without the distances of all samples to all lines in reach."""
    r = random.Random(5)
    lines = [(i, x := r.random(), y := r.random(), x + r.random() / 9, y - r.random() / 9) for i in range(120)]
    lines += [(200, *lines[3][1:]), (201, 0.5, 0.5, 0.5, 0.5)]
    segments = spark.createDataFrame(lines, "line_id long, ax double, ay double, bx double, by double")
    walks = [(i, x + k / 50, y - k / 90) for i in range(40) for x, y in [(r.random(), r.random())] for k in range(4)] + [(99, 0.1, float("nan"))]
    samples = spark.createDataFrame(walks, "id long, x double, y double")

    def far(px, py, ax, ay, bx, by):
        square = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / square)) if square else 0.0
        return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    wanted = {}
    for i in range(40):
        for line, *ends in lines:
            d = [far(x, y, *ends) for w, x, y in walks if w == i]
            if max(d) <= 0.2 and sum(d) / 4 <= 0.1:
                wanted[i] = min(wanted.get(i, (9, 9)), (round(sum(d) / 4, 9), line))
    monkeypatch.setattr(spatial, "lines_within", None)
    found = spatial.matched_lines(samples, segments, "id", 0.1, 0.2).collect()
    assert {x["id"]: (round(x["mean_dist"], 9), x["line_id"]) for x in found} == wanted


def test_first_reach_follows_the_number_of_places(spark, monkeypatch):
    """Many rows of a few places look around once each, and not as far as the cell among many lines."""
    seen, plain = [], spatial._segments_within
    monkeypatch.setattr(spatial, "_segments_within", lambda left, held, reach: seen.append((left.count(), reach)) or plain(left, held, reach))
    rows = spark.range(300).select("id", (F.col("id") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"))
    lines = spark.range(400).select(F.col("id").alias("line_id"), (F.col("id") / 100).alias("ax"), F.lit(0.01).alias("ay"), (F.col("id") / 100).alias("bx"), F.lit(1.0).alias("by"))
    found = {(x["id"] % 3, x["line_id"], round(x["dist"], 9)) for x in spatial.nearest_lines(rows, lines, "id", "x", "y", 50.0).collect()}
    assert found == {(0, 0, 0.01), (1, 100, 0.01), (2, 200, 0.01)} and seen[0][0] == 3 and seen[0][1] < 1
    twins = {x["id"]: (x["nearest"], x["dist"]) for x in spatial.nearest_points(rows.where("id < 8 AND id <> 5"), "id", "x", "y", 50.0).collect()}
    assert twins == {0: (3, 0.0), 3: (0, 0.0), 6: (0, 0.0), 1: (4, 0.0), 4: (1, 0.0), 7: (1, 0.0), 2: (1, 1.0)}
