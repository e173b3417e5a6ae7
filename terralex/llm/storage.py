"""Code shipping for the corpus operators, and the shared-folder tables of ``terralex.staging``."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from terralex.staging import discard, shared_dir, stage, stage_by

__all__ = ["discard", "shared_dir", "ship", "stage", "stage_by"]

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and bound the rows and bytes of an Arrow batch."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
