"""Map inputs: raw map extracts, GeoJSON, script-wrapped JSON, exports with coordinates, GeoPackage layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex.sources.geopackage import GeoPackageSource

POINT = "STRUCT<lat: DOUBLE, lon: DOUBLE>"
ELEMENTS = f"""elements ARRAY<STRUCT<type: STRING, id: LONG, lat: DOUBLE, lon: DOUBLE, center: {POINT}, nodes: ARRAY<LONG>, tags: MAP<STRING, STRING>,
    members: ARRAY<STRUCT<type: STRING, role: STRING, geometry: ARRAY<{POINT}>>>>>"""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches, in whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def optional(spark: SparkSession, path: str, schema: str, fmt: str = "json", **options) -> DataFrame:
    """A table that may be missing: then it has the schema and no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def first_file(spark: SparkSession, root: str, suffix: str) -> str | None:
    """The first file by path below ``root`` that ends in ``suffix``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    return files.agg(F.min("path")).first()[0]


def elements(spark: SparkSession, path: str) -> DataFrame:
    """One row per node, way or relation of an extract; its size is that of a city, its tags stay a map."""
    doc = spark.read.schema(ELEMENTS).option("multiLine", True).json(path)
    return doc.select(F.explode("elements").alias("e")).select("e.*")


def nodes(found: DataFrame) -> DataFrame:
    return found.where("type = 'node'").select(F.col("id").alias("node"), "lat", "lon")


def ways(found: DataFrame) -> DataFrame:
    """(way, name, highway, footway, pos, node) of named ways, in order."""
    tag = lambda k: F.try_element_at("tags", F.lit(k)).alias(k)
    return found.where("type = 'way'").select(F.col("id").alias("way"), tag("name"), tag("highway"), tag("footway"), F.posexplode("nodes").alias("pos", "node"))


def outer_parts(found: DataFrame) -> DataFrame:
    """(relation, name, parts): the outer ways of each relation as arrays of points (x = lon, y = lat), in order."""
    outer = F.filter("members", lambda m: (m["type"] == "way") & (m["role"] == "outer") & m["geometry"].isNotNull())
    points = F.transform(outer, lambda m: F.transform(m["geometry"], lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))))
    return found.where("type = 'relation'").select(F.col("id").alias("relation"), F.try_element_at("tags", F.lit("name")).alias("name"), points.alias("parts")).where(F.size("parts") > 0)


def located(found: DataFrame) -> DataFrame:
    """Elements with their own coordinates or else their centre's; a zero counts as missing; others are left out."""
    own = lambda f: F.coalesce(F.nullif(F.col(f), F.lit(0.0)), F.col(f"center.{f}"))
    return found.withColumn("lat", own("lat")).withColumn("lon", own("lon")).where("lat IS NOT NULL AND lon IS NOT NULL")


def export_position(df: DataFrame, point: str = "geo_point_2d", x: str = "x_4326", y: str = "y_4326") -> DataFrame:
    """``lat`` and ``lon`` of an export: the point, else the pair of columns where neither is 0; rows without are left out."""
    pair = F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != 0) & (F.col(y) != 0)
    lat = F.when(F.col(point).isNotNull(), F.col(f"{point}.lat")).when(pair, F.col(y))
    lon = F.when(F.col(point).isNotNull(), F.col(f"{point}.lon")).when(pair, F.col(x))
    return df.withColumn("lat", lat).withColumn("lon", lon).where("lat IS NOT NULL AND lon IS NOT NULL")


PLAQUE = f"geo_point_2d {POINT}, x_4326 DOUBLE, y_4326 DOUBLE, titre STRING, retranscription STRING, adresse STRING"


def plaques(spark: SparkSession, path: str) -> DataFrame:
    """An export of plaques: one JSON array of records; a missing file gives no rows. ``id`` numbers them by content."""
    rows = optional(spark, path, PLAQUE, multiLine=True)
    return rows.withColumn("id", F.xxhash64(*rows.columns))


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(properties columns, kind, rings): polygon features; a missing file gives no rows.

    ``rings`` lists every polygon's rings, its shell first.
    """
    schema = f"features ARRAY<STRUCT<properties: STRUCT<{properties}>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"
    doc = optional(spark, path, schema, multiLine=True)
    feature = doc.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("_c"))
    many = F.from_json("_c", "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>")
    one = F.array(F.from_json("_c", "ARRAY<ARRAY<ARRAY<DOUBLE>>>"))
    pairs = F.transform(F.when(F.col("kind") == "Polygon", one).otherwise(many), lambda g: F.transform(g, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
    return feature.withColumn("rings", pairs).drop("_c")


def first_column(df: DataFrame, *names: str) -> str:
    """The first of the names that the table has."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of the columns {', '.join(names)}")


def script_json(spark: SparkSession, path: str, schema: str, prefix: str | None = None) -> DataFrame:
    """A document that a script assigns to a variable: one row per file, or per element where the schema is an array.

    With ``prefix`` the file must begin with it; else everything up to the first = goes.
    """
    text = spark.read.text(path, wholetext=True)
    body = F.regexp_replace("value", r"^[^=]*=", "") if prefix is None else F.when(F.startswith("value", F.lit(prefix)), F.substring("value", len(prefix) + 1, 2_000_000_000))
    parsed = text.select(F.from_json(F.regexp_replace(F.trim(body), r";\s*$", ""), schema).alias("d")).where("d IS NOT NULL")
    if schema.strip().upper().startswith("ARRAY"):
        return parsed.select(F.explode("d").alias("d")).select("d.*")
    return parsed.select("d.*")


def layer(spark: SparkSession, path: str, name: str, partitions: int = 8) -> DataFrame:
    """A GeoPackage layer: its columns, and ``parts``, the geometry's lines or rings as arrays of points (x, y)."""
    spark.dataSource.register(GeoPackageSource)
    return spark.read.format("geopackage").option("layer", name).option("partitions", partitions).load(path)


def flattened(df: DataFrame, key: str, name: str, parts: str = "parts") -> DataFrame:
    """(line, name, pos, x, y): one line per part, numbered by the key and the part; heights are gone already."""
    part = df.select(F.col(key).alias("_k"), F.col(name).alias("name"), F.posexplode(parts).alias("_i", "_p")).where(F.size("_p") >= 2)
    return part.select(F.struct("_k", "_i").alias("line"), "name", F.posexplode("_p").alias("pos", "_v")).select("line", "name", "pos", "_v.x", "_v.y")


def is_image(content: Column) -> Column:
    """Whether bytes begin like a JPEG or PNG."""
    return (F.substring(content, 1, 3) == F.unhex(F.lit("FFD8FF"))) | (F.substring(content, 1, 4) == F.unhex(F.lit("89504E47")))


def images(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(is_image(F.col("content")))
