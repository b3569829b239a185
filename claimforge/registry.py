"""All queries of the engine, by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.queries import QUERIES, SQL


def engine_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def engine_sql() -> dict[str, str]:
    return dict(SQL)
