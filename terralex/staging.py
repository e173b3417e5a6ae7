"""Tables in the shared folder that ``spark.checkpoint.dir`` names: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder is set only where a local session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = Path(tempfile.gettempdir(), "checkpoints").as_uri()
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it again: no lineage, known size, columns pruned by readers."""
    spark, path = df.sparkSession, _fresh(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """``stage`` with a folder for each value of ``column``, so that readers of some values open their files only."""
    spark, path = df.sparkSession, _fresh(df.sparkSession, name)
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def discard(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
