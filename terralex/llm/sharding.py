"""Sharding along a Hilbert curve over quantised metadata, with DataFrame functions only.

Rows that are near in every dimension get near places on the curve, so a run of the curve holds few values of each
dimension, and files cut from runs can be skipped by filters on any of them. Cuts follow the law ``rows``: shard
counts differ by one at most.

``write_shards`` writes the rows themselves: files by shard, sorted along the curve, and each shard's range of every
dimension, by which readers skip shards.

Defined results: a null dimension counts as its largest value; null text has size 1 and the checksum of no bytes;
repeated rows take neighbouring slots (``write_shards`` keeps them in one shard); an empty table gives no rows; a very
long text is one value of a column; columns other than doc_id, text and the dimensions, whatever their names, are only
handed on by ``write_shards``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.llm.keys import lookup, seeded_key, unused
from terralex.llm.storage import stage

SHARDS = 8
BITS = 4
SEED = 29
#: A cell with many rows is cut into parts of about this share of all rows.
PARTS = 4096


@lru_cache
def hilbert_table(dims: int, bits: int) -> tuple[int, ...]:
    """Place on the curve of each cell of a ``dims``-dimensional grid, cells in row-major order.

    Skilling's transform from axes to a transposed index; the grid is small and fixed, so the table is a constant.
    """
    if dims * bits > 16:
        raise ValueError("a grid of more than 65536 cells")
    table = []
    for cell in range(1 << (dims * bits)):
        x = [(cell >> (bits * (dims - 1 - i))) & ((1 << bits) - 1) for i in range(dims)]
        q = 1 << (bits - 1)
        while q > 1:
            for i in range(dims):
                if x[i] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[i]) & (q - 1)
                    x[0] ^= t
                    x[i] ^= t
            q >>= 1
        for i in range(1, dims):
            x[i] ^= x[i - 1]
        t, q = 0, 1 << (bits - 1)
        while q > 1:
            if x[-1] & q:
                t ^= q - 1
            q >>= 1
        x = [v ^ t for v in x]
        place = 0
        for b in reversed(range(bits)):
            for v in x:
                place = place << 1 | (v >> b) & 1
        table.append(place)
    return tuple(table)


def cut_points(docs: DataFrame, dim: str, bits: int) -> list[tuple[int, object]]:
    """(class, its smallest value) of at most 2**bits classes of about equally many rows, nulls aside; a class that has no
    value of its own is left out."""
    classes = 1 << bits
    counts = docs.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("v")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.floor(before * classes / F.sum("n").over(Window.partitionBy()))
    return [(r["c"], r["v"]) for r in counts.select("v", rank.alias("c")).groupBy("c").agg(F.min("v").alias("v")).orderBy("v").collect()]


def quantised(docs: DataFrame, dim: str, bits: int, even: bool = False) -> Column:
    """Numbers: octaves. Strings: classes of equal weight in the order of values, numbered one by one. Null: the top class.

    ``even`` cuts numbers into classes of equal weight too, and gives every class its place among all rows, so that each
    half of the grid holds about half of them whatever their distribution.
    """
    top = (1 << bits) - 1
    if dict(docs.dtypes)[dim] == "string":
        cuts = cut_points(docs, dim, bits)
        places = [c for c, _ in cuts] if even else list(range(len(cuts)))
        rank = F.greatest(F.lit(0), F.lit(0), *[F.when(F.col(dim) >= v, c).otherwise(0) for c, (_, v) in zip(places, cuts, strict=True)])
        return F.when(F.col(dim).isNull(), F.lit(top)).otherwise(rank).cast("int")
    if even:
        cuts = docs.agg(F.percentile_approx(dim, [i / (top + 1) for i in range(1, top + 1)], 10_000)).first()[0] or []
        rank = sum([F.when(F.col(dim) >= v, 1).otherwise(0) for v in cuts], F.lit(0))
        return F.coalesce(rank, F.lit(0)).cast("int") if not cuts else F.when(F.col(dim).isNull(), F.lit(top)).otherwise(rank).cast("int")
    octave = F.length(F.bin(F.greatest(F.col(dim).cast("long"), F.lit(0))))
    return F.coalesce(F.least(octave, F.lit(top)), F.lit(top)).cast("int")


DIMS = ("lang", "source", "n_chars")


def curve_place(docs: DataFrame, dims: tuple[str, ...] = DIMS, bits: int = BITS, even: bool = False) -> Column:
    """Where the row's cell of the grid of quantised dimensions lies on the curve."""
    cell = F.lit(0)
    for dim in dims:
        cell = cell * (1 << bits) + quantised(docs, dim, bits, even)
    return lookup(hilbert_table(len(dims), bits), cell)


def along_curve(docs: DataFrame, curve: Column) -> DataFrame:
    """doc_id, size, text_crc32, ``curve`` and ``place`` (a seeded order within a cell), staged: the one pass over texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        curve.alias("curve"),
        seeded_key(SEED, F.col("doc_id"), F.col("text")).alias("place"),
    )
    return stage(slim, "shard-curve")


def sharded(docs: DataFrame, shards: int = SHARDS, curve: Column | None = None, **settings) -> DataFrame:
    """Shard and gapless slot of every row by its rank on the curve.

    Ranks come from two sums: over (cell, part) ranges, at most 2 * PARTS of them, and within a range. Cells are cut
    into parts of about 1 / PARTS of all rows, so a cell that holds a third of them spreads over many tasks.
    """
    slim = along_curve(docs, curve_place(docs, **settings) if curve is None else curve)
    total = slim.count()
    counts = slim.groupBy("curve").agg(F.count("*").alias("n"))
    cells = counts.select("curve", F.greatest(F.lit(1), F.ceil(F.col("n") * PARTS / max(total, 1))).alias("parts"))
    step = F.conv(F.substring("place", 1, 4), 16, 10).cast("long")
    # at most 65536 cells, and at most 65536 + PARTS ranges, whatever the input
    parted = slim.join(F.broadcast(cells), "curve").withColumn("part", F.floor(step * F.col("parts") / 65536)).drop("parts")
    ranges = parted.groupBy("curve", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("curve", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("curve", "part", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("curve", "part").orderBy("place", "doc_id"))
    rank = parted.join(F.broadcast(ranges), ["curve", "part"]).withColumn("rank", F.col("before") + within - 1)
    shard = F.expr(f"rank * {shards} div {max(total, 1)}")
    return rank.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr(f"rank - (shard * {total}L + {shards - 1}) div {shards}"))


def shard_report(docs: DataFrame) -> DataFrame:
    """One row per document with its shard, slot and place on the curve."""
    return sharded(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("curve").cast("int").alias("curve"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dims: tuple[str, ...] = DIMS, bits: int = BITS, even: bool = True) -> DataFrame:
    """Write the rows with all their columns into ``path``, a folder for each shard, and return (shard, n, low_*, high_* of
    each dimension), which is also kept in ``path``/_ranges.

    ``even`` balances the grid, which rules out more shards; without it, shards are those of the report. A shard's cut is the least (curve, place, doc_id) in it, so rows find their shard without a join; texts are shuffled
    once, by ranges of the curve.
    """
    curve, mark, place, shard = curve_place(docs, dims, bits, even), *(unused(docs, f"_{c}") for c in ("curve", "place")), unused(docs, "shard")
    least = F.min(F.struct("curve", "place", "doc_id")).alias("cut")
    cuts = [r["cut"] for r in sharded(docs, shards, curve).groupBy("shard").agg(least).orderBy("shard").collect()]  # one a shard
    keyed = docs.withColumn(mark, curve).withColumn(place, seeded_key(SEED, F.col("doc_id"), F.col("text")))
    own = F.struct(F.col(mark).cast("int").alias("curve"), F.col(place).alias("place"), F.col("doc_id").alias("doc_id"))
    kind = docs.schema["doc_id"].dataType
    passed = [F.when(own >= F.struct(F.lit(c["curve"]).cast("int").alias("curve"), F.lit(c["place"]).alias("place"), F.lit(c["doc_id"]).cast(kind).alias("doc_id")), 1).otherwise(0) for c in cuts[1:]]
    placed = keyed.withColumn(shard, sum(passed, F.lit(0)).cast("int"))
    ordered = placed.repartitionByRange(shard, mark, place).sortWithinPartitions(shard, mark, place)
    ordered.drop(mark, place).write.partitionBy(shard).parquet(path)
    written = docs.sparkSession.read.schema(ordered.drop(mark, place).schema).parquet(path)
    bounds = [f(F.col(d)).alias(f"{name}_{d}") for d in dims for f, name in ((F.min, "low"), (F.max, "high"))]
    written.groupBy(F.col(shard).alias("shard")).agg(F.count("*").alias("n"), *bounds).coalesce(1).write.parquet(f"{path}/_ranges")
    return docs.sparkSession.read.parquet(f"{path}/_ranges")


def _octave_sql(dim: str) -> str:
    return f"coalesce(least(length(bin(greatest({dim}, 0))), 15), 15)"


def _class_sql(dim: str) -> str:
    return f"""(SELECT v, dense_rank() OVER (ORDER BY c) - 1 AS q
      FROM (SELECT v, floor(coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 16.0 / sum(n) OVER ()) AS c
            FROM (SELECT {dim} AS v, count(*) AS n FROM documents WHERE {dim} IS NOT NULL GROUP BY 1)))"""


def oracle() -> str:
    """DuckDB has no CRC-32; it is spelled out here as a fold over the bytes of the text."""
    crc = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        crc.append(i)
    return rf"""
WITH tables AS (SELECT {list(hilbert_table(3, 4))} AS curve_of, {crc}::BIGINT[] AS crc_of),
cells AS (
  SELECT d.doc_id, coalesce(d.text, '') AS text, curve_of[coalesce(a.q, 15) * 256 + coalesce(b.q, 15) * 16 + {_octave_sql("d.n_chars")} + 1] AS curve,
    md5(concat_ws(':', '{SEED}', coalesce(d.doc_id::VARCHAR, ''), md5(coalesce(d.text, '')))) AS place
  FROM documents d CROSS JOIN tables LEFT JOIN {_class_sql("lang")} a ON d.lang = a.v LEFT JOIN {_class_sql("source")} b ON d.source = b.v),
ranked AS (SELECT *, row_number() OVER (ORDER BY curve, place, doc_id) - 1 AS rank, count(*) OVER () AS total FROM cells),
sums AS (
  SELECT doc_id, rank, total, curve, strlen(text) + 1 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT)),
      lambda c, x: xor(c >> 8, crc_of[(xor(c, x) & 255) + 1]))) AS text_crc32
  FROM ranked CROSS JOIN tables)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (rank * 8 // total)::INTEGER AS shard,
  (rank - ((rank * 8 // total) * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard, curve::INTEGER AS curve
FROM sums
"""
