"""Row-preserving maps over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from terralex.llm.storage import ship


def give_back() -> None:
    """Return memory that this worker has freed to the system; it may idle beside other tasks for long."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def mapped(df: DataFrame, keep: list[str], columns: str, fn: Callable[[pa.RecordBatch], list], after: Callable[[], None] | None = None) -> DataFrame:
    """Columns ``keep`` of ``df`` followed by ``columns`` (DDL), which ``fn`` gives for each batch as lists or arrays.
    ``after`` is called at the end of a task: workers outlive it, so what it remembered should not."""
    ship(df.sparkSession)
    ddl = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [columns])
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [batch.column(c) for c in keep] + list(fn(batch))
            arrays = [a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(made, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        if after:
            after()
        give_back()

    return df.mapInArrow(run, ddl)
