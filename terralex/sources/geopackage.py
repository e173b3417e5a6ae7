"""A Spark data source for GeoPackage layers: SQLite tables whose geometries are well-known binary behind a short header.

A file must lie where driver and executors can open it (SQLite reads at random places). Tasks read ranges of row ids.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_TYPES = {"INTEGER": "long", "INT": "long", "MEDIUMINT": "long", "SMALLINT": "long", "TINYINT": "long", "BOOLEAN": "boolean", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BLOB": "binary"}
_ENVELOPE = (0, 32, 48, 48, 64)


def _points(data: bytes, at: int, order: str, dims: int) -> tuple[list[tuple[float, float]], int]:
    (n,) = struct.unpack_from(order + "I", data, at)
    values = struct.unpack_from(f"{order}{n * dims}d", data, at + 4)
    return list(zip(values[0::dims], values[1::dims], strict=True)), at + 4 + 8 * n * dims


def well_known_binary(data: bytes, at: int = 0) -> tuple[list[list[tuple[float, float]]], int]:
    """(lines or rings or points, place after them); heights and measures are left out."""
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    high = code & 0xC0000000
    kind, extra = (code & 0x0FFFFFFF) % 1000, ((code & 0x0FFFFFFF) // 1000)
    dims = 2 + ((extra in (1, 2)) + 2 * (extra == 3) if not high else bin(high).count("1"))
    at += 5
    if kind == 1:
        p = struct.unpack_from(f"{order}{dims}d", data, at)
        return [[(p[0], p[1])]], at + 8 * dims
    if kind == 2:
        line, at = _points(data, at, order, dims)
        return [line], at
    (n,) = struct.unpack_from(order + "I", data, at)
    at += 4
    out: list[list[tuple[float, float]]] = []
    for _ in range(n):
        if kind == 3:
            ring, at = _points(data, at, order, dims)
            out.append(ring)
        else:
            parts, at = well_known_binary(data, at)
            out += parts
    return out, at


def geometry(blob: bytes | None) -> list[list[tuple[float, float]]] | None:
    if not blob or blob[:2] != b"GP":
        return None
    return well_known_binary(blob, 8 + _ENVELOPE[blob[3] >> 1 & 7])[0]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, layer: str, partitions: int, columns: list[str], shape: str | None):
        self.path, self.layer, self.count, self.columns, self.shape = path, layer, partitions, columns, shape

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)

    def partitions(self) -> list[InputPartition]:
        con = self._open()
        low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.layer)}").fetchone()
        con.close()
        if low is None:
            return [_Rows(0, -1)]
        step = -(-(high - low + 1) // self.count)
        return [_Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        con = self._open()
        listed = ", ".join(map(_quoted, [*self.columns, *([self.shape] if self.shape else [])]))
        for row in con.execute(f"SELECT {listed} FROM {_quoted(self.layer)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high)):
            parts = geometry(row[-1]) if self.shape else None
            plain = row[:-1] if self.shape else row
            yield (*plain, None if parts is None else [[{"x": x, "y": y} for x, y in p] for p in parts])
        con.close()


class GeoPackageSource(DataSource):
    """``spark.read.format("geopackage").option("layer", ...).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _layout(self) -> tuple[list[tuple[str, str]], str | None]:
        con = sqlite3.connect(f"file:{self._path()}?mode=ro&immutable=1", uri=True)
        columns = con.execute(f"PRAGMA table_info({_quoted(self.options['layer'])})").fetchall()
        shape = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (self.options["layer"],)).fetchone()
        con.close()
        if not columns:
            raise ValueError(f"no layer {self.options['layer']}")
        own = shape[0] if shape else None
        return [(c[1], _TYPES.get(c[2].split("(")[0].upper(), "string")) for c in columns if c[1] != own], own

    def _path(self) -> str:
        return self.options["path"].removeprefix("file://")

    def schema(self) -> str:
        columns, _ = self._layout()
        return ", ".join([*(f"`{n}` {t}" for n, t in columns), "parts array<array<struct<x:double,y:double>>>"])

    def reader(self, schema: StructType) -> DataSourceReader:
        columns, shape = self._layout()
        return _Reader(self._path(), self.options["layer"], int(self.options.get("partitions", 8)), [n for n, _ in columns], shape)
