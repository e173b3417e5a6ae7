"""All registered queries of the library itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terralex.plans import city_queries, relational_queries, source_queries, spatial_queries, text_queries

_ALL = text_queries.ALL | spatial_queries.ALL | relational_queries.ALL | city_queries.ALL | source_queries.ALL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
