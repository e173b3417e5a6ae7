"""Planar and spherical geometry as column expressions; rings and lines are arrays of structs (x, y)."""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

EARTH_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
LINE = ArrayType(StructType().add("x", DoubleType()).add("y", DoubleType()))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(h))


def local_xy(lat: Column, lon: Column, lat0: float) -> tuple[Column, Column]:
    """Metres in a plane that is true at latitude ``lat0``."""
    return lon * (math.cos(math.radians(lat0)) * METRES_PER_DEGREE), lat * METRES_PER_DEGREE


def local_latlon(x: Column, y: Column, lat0: float) -> tuple[Column, Column]:
    return y / METRES_PER_DEGREE, x / (math.cos(math.radians(lat0)) * METRES_PER_DEGREE)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance to the nearest point of a segment, which may be a point."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square))).otherwise(0.0)
    return F.sqrt(F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule; the ring may be open or closed."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))
        at = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < at), 1).otherwise(0)

    edges = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), crosses)
    return F.when(n >= 3, F.aggregate(edges, F.lit(0), lambda s, e: s + e) % 2 == 1).otherwise(False)


def in_polygon(x: Column, y: Column, shell: Column, holes: Column) -> Column:
    """In the shell and in none of the holes."""
    return in_ring(x, y, shell) & ~F.exists(holes, lambda h: in_ring(x, y, h))


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies on a side of the ring."""
    n = F.size(ring)

    def touches(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))
        return segment_distance(x, y, a["x"], a["y"], b["x"], b["y"]) == 0

    return F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), touches)


def sides(ring: Column) -> Column:
    """The sides of a ring, open or closed, as an array of structs (ax, ay, bx, by) without empty ones."""
    n = F.size(ring)

    def side(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))
        return F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))

    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), side)
    return F.when(n >= 2, F.filter(every, lambda s: (s["ax"] != s["bx"]) | (s["ay"] != s["by"]))).otherwise(F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>"))


def legs(line: Column) -> Column:
    """The segments of a line as an array of structs (a, b)."""
    n = F.size(line)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.element_at(line, i).alias("a"), F.try_element_at(line, i + 1).alias("b")))
    return F.when(n >= 2, pairs).otherwise(F.slice(pairs, 1, 0))


def segments_meet(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    """Whether two segments (ax, ay, bx, by) have a point in common."""
    (pax, pay, pbx, pby), (qax, qay, qbx, qby) = p, q
    rx, ry, sx, sy = pbx - pax, pby - pay, qbx - qax, qby - qay
    cross = F.nullif(rx * sy - ry * sx, F.lit(0.0))
    t, u = ((qax - pax) * sy - (qay - pay) * sx) / cross, ((qax - pax) * ry - (qay - pay) * rx) / cross
    ends = [segment_distance(x, y, *other) == 0 for other, own in ((q, p), (p, q)) for x, y in ((own[0], own[1]), (own[2], own[3]))]
    return F.coalesce(t.between(0, 1) & u.between(0, 1), F.lit(False)) | ends[0] | ends[1] | ends[2] | ends[3]


def envelope_area(ring: Column) -> Column:
    extent = lambda f: F.array_max(F.transform(ring, lambda p: p[f])) - F.array_min(F.transform(ring, lambda p: p[f]))
    return extent("x") * extent("y")


def ring_area(ring: Column) -> Column:
    """Signed shoelace area, positive when counter-clockwise."""
    n = F.size(ring)

    def cross(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))
        return a["x"] * b["y"] - b["x"] * a["y"]

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), cross), F.lit(0.0), lambda s, v: s + v) / 2


def ring_centre(ring: Column) -> Column:
    """Mean of the vertices, unweighted."""
    mean = lambda f: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[f]) / F.size(ring)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def largest_ring(rings: Column) -> Column:
    """First of the rings with the largest area."""
    sized = F.transform(rings, lambda r, i: F.struct(F.abs(ring_area(r)).alias("area"), (-i).alias("first"), r.alias("ring")))
    return F.array_max(sized)["ring"]


def rounded_ring(ring: Column, digits: int = 5) -> Column:
    return F.transform(ring, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))


def middle_point(line: Column) -> Column:
    return F.element_at(line, F.floor(F.size(line) / 2).cast("int") + 1)


def densified(ax: Column, ay: Column, bx: Column, by: Column, step: float) -> Column:
    """Points along a segment, both ends included, at most ``step`` apart."""
    parts = F.greatest(F.lit(1), F.ceil(F.sqrt(F.pow(bx - ax, 2) + F.pow(by - ay, 2)) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), parts), lambda i: F.struct((ax + (bx - ax) * i / parts).alias("x"), (ay + (by - ay) * i / parts).alias("y")))


def grid_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    return F.floor(x / size).cast("long"), F.floor(y / size).cast("long")


def simplified_line(points: list[tuple[float, float]], eps: float) -> list[tuple[float, float]]:
    """Douglas-Peucker without recursion: ends stay, a point farther than ``eps`` splits, the first farthest wins."""
    if len(points) < 3:
        return points
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        dx, dy = bx - ax, by - ay
        square, far, at = dx * dx + dy * dy, eps, -1
        for i in range(a + 1, b):
            px, py = points[i]
            t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / square)) if square else 0.0
            d = math.hypot(px - ax - t * dx, py - ay - t * dy)
            if d > far:
                far, at = d, i
        if at >= 0:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


def flat_simplified(lines: pa.Array, eps: float) -> pa.Array:
    """``simplified_line`` of each line: one line at a time becomes Python's points, the batch and the result stay flat."""
    missing, xs, ys, ends = [], array("d"), array("d"), array("i", [0])
    for line in lines:
        missing.append(not line.is_valid)
        if line.is_valid:
            points = line.values
            for x, y in simplified_line(list(zip(points.field("x").to_pylist(), points.field("y").to_pylist(), strict=True)), eps):
                xs.append(x)
                ys.append(y)
        ends.append(len(xs))
    flat = pa.StructArray.from_arrays([pa.array(np.array(v, np.float64)) for v in (xs, ys)], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), flat, mask=pa.array(missing, pa.bool_()))


def simplify(line: Column, eps: float) -> Column:
    """Douglas-Peucker over an array of structs (x, y)."""

    @F.arrow_udf(LINE)
    def run(lines: pa.Array) -> pa.Array:
        return flat_simplified(lines, eps)

    return run(line)
