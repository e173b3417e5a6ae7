import math
import random

import pytest

from terralex.operators import spatial

ODD = [None, float("nan"), float("inf"), -float("inf")]


def on_segment(px, py, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / square)) if square else 0.0
    return math.hypot(px - ax - t * dx, py - ay - t * dy)


def test_nearest_lines_end_on_odd_coordinates(spark):
    """Null, NaN and infinite coordinates, an outlier on either side, a very long segment and a point as a segment."""
    r = random.Random(1)
    points = [(i, r.uniform(0, 10), r.uniform(0, 10)) for i in range(60)] + [(100, 1e7, -3e6)] + [(200 + i, v, 1.0) for i, v in enumerate(ODD)] + [(300 + i, 1.0, v) for i, v in enumerate(ODD)]
    lines = [(i, *(r.uniform(0, 10) for _ in range(4))) for i in range(20)] + [(50, -1e8, 5.0, 1e8, 5.0), (51, 3.0, 3.0, 3.0, 3.0)]
    odd = [(60 + i, v, 0.0, 1.0, 1.0) for i, v in enumerate(ODD)] + [(70 + i, 0.0, 0.0, 1.0, v) for i, v in enumerate(ODD)]
    p = spark.createDataFrame(points, "id long, x double, y double")
    s = spark.createDataFrame(lines + odd, "line_id long, ax double, ay double, bx double, by double")
    got = {x.id: (x.line_id, x.dist) for x in spatial.nearest_lines(p, s, "id", "x", "y", 0.05).collect()}
    assert set(got) == {i for i, *_ in points}
    for i, x, y in points:
        if i >= 200:
            assert got[i] == (None, None)
        else:
            want = min((on_segment(x, y, *l[1:]), l[0]) for l in lines)
            assert got[i][1] == pytest.approx(want[0], rel=1e-9, abs=1e-9) and got[i][0] == want[1]
    for none in (s.where("line_id >= 60"), s.limit(0)):
        assert {(x.line_id, x.dist) for x in spatial.nearest_lines(p, none, "id", "x", "y", 0.05).collect()} == {(None, None)}
    assert spatial.nearest_lines(p.limit(0), s, "id", "x", "y", 0.05).count() == 0


def test_nearest_points_end_on_odd_coordinates(spark):
    r = random.Random(2)
    points = [(i, r.uniform(0, 10), r.uniform(0, 10)) for i in range(80)] + [(100, 5e8, 1.0), (101, 2.0, 2.0), (102, 2.0, 2.0)]
    odd = [(200 + i, v, 1.0) for i, v in enumerate(ODD)]
    p = spark.createDataFrame(points + odd, "id long, x double, y double")
    got = {x.id: (x.nearest, x.dist) for x in spatial.nearest_points(p, "id", "x", "y", 0.05).collect()}
    assert set(got) == {i for i, *_ in points}
    for i, x, y in points:
        want = min((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, a, b in points if j != i)
        assert got[i] == (want[1], pytest.approx(want[0]))
    assert spatial.nearest_points(p.where("id = 3 OR id > 199"), "id", "x", "y", 0.05).count() == 0
    assert spatial.nearest_points(p.limit(0), "id", "x", "y", 0.05).count() == 0


def test_sample_columns_may_have_any_names(spark):
    r = random.Random(3)
    names = ["x", "y", "cx", "level", "dist2", "ax", "sample"]
    rows = [tuple(r.uniform(0, 3) for _ in names) for _ in range(30)]
    lines = [(i, *(r.uniform(0, 3) for _ in range(4))) for i in range(12)]
    found = spatial.lines_within(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), spark.createDataFrame(lines, "line_id long, ax double, ay double, bx double, by double"), 0.4)
    assert found.columns == [*names, "line_id", "dist"]
    got = {(tuple(x)[:7], x.line_id): x.dist for x in found.collect()}
    want = {(row, l[0]): d for row in rows for l in lines if (d := on_segment(row[0], row[1], *l[1:])) <= 0.4}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_simplified_lines_stay_flat(spark):
    """Lines of a batch are worked on one at a time: memory follows the batch's bytes, not Python objects for all its points."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import functions as F

    from terralex.functions import geo

    r = random.Random(1)
    lines = [[(float(i), r.random()) for i in range(n)] for n in (0, 1, 2, 50, 3)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*lines, None])], "id int, line array<struct<x:double,y:double>>").coalesce(1)
    got = {x.id: x.s for x in df.select("id", geo.simplify(F.col("line"), 0.3).alias("s")).collect()}
    assert got[5] is None and all([tuple(p) for p in got[i]] == geo.simplified_line(v, 0.3) for i, v in enumerate(lines))
    batch = pa.array([[{"x": float(i), "y": 0.0} for i in range(200)]] * 2000, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    tracemalloc.start()
    made = geo.flat_simplified(batch, 1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == 2000 and peak < 5_000_000
