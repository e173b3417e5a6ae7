"""Outputs: script-wrapped JSON, work lists, swapped tables, idempotent upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from terralex.operators.ordered import first_writers
from terralex.staging import discard, stage


def write_script_json(df: DataFrame, path: str, variable: str, order: list[str]) -> None:
    """One compact JSON array behind an assignment, in a stated order.

    A single document is one string and so one task: this is an export of a finished, city-sized table.
    """
    rows = df.select(F.struct(*[F.col(c) for c in order]).alias("_o"), F.to_json(F.struct(*df.columns)).alias("_j"))
    body = F.concat(F.lit(f"{variable}=["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_j"))), lambda r: r["_j"]), ","), F.lit("];"))
    rows.agg(body.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_work_list(df: DataFrame, path: str) -> None:
    """Tab-separated lines."""
    df.write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """What is wanted and not yet there."""
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def swap(df: DataFrame, path: str) -> None:
    """Replace a table that ``df`` may itself read: write beside it, then rename."""
    spark = df.sparkSession
    new, old = f"{path}.{uuid.uuid4().hex[:8]}", f"{path}.{uuid.uuid4().hex[:8]}"
    df.write.parquet(new)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)


def table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """An append-only table; empty before its first write."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


#: Folders of a table's key index; a batch reads those that its own keys fall into.
PARTS = 64


def _part(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")


def _index(spark: SparkSession, path: str, keys: list[str], schema: StructType) -> DataFrame:
    """(keys, part) of all rows of a table, kept beside it. Files of the table that the index doesn't know yet, such as
    those of the last batch or of one that was cut short, are read and added first; a key that is added twice does no
    harm."""
    home = f"{path}.keys"
    own = StructType([schema[k] for k in keys])
    kept = StructType([*own.fields, StructField("part", IntegerType())])
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [str(f.getPath()) for f in fs.listStatus(at) if f.getPath().getName().endswith(".parquet")] if fs.exists(at) else []
    known = {r["file"] for r in table(spark, f"{home}/files", "file string").collect()}
    new = [f for f in files if f.rsplit("/", 1)[1] not in known]
    if new:
        spark.read.schema(own).parquet(*new).withColumn("part", _part(keys)).repartition("part").write.mode("append").partitionBy("part").parquet(f"{home}/rows")
        spark.createDataFrame([(f.rsplit("/", 1)[1],) for f in new], "file string").coalesce(1).write.mode("append").parquet(f"{home}/files")
    return table(spark, f"{home}/rows", kept)


def insert_new(rows: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Append the first row of each key that the table doesn't have; running it again changes nothing.

    The table's keys are looked up in an index by hash, of which only the folders of the batch's keys are read.
    """
    spark = rows.sparkSession
    fresh = stage(first_writers(rows, keys, order), "upsert")
    parts = [r["part"] for r in fresh.select(_part(keys).alias("part")).distinct().collect()]  # at most PARTS
    have = _index(spark, path, keys, rows.schema).where(F.col("part").isin(parts)).select(*keys)
    fresh.join(have, keys, "left_anti").write.mode("append").parquet(path)
    discard(fresh)
