"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the semantics are SQL-expressible, the equivalent DuckDB SQL over
the same parquet tables (views named like the files)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query builder under ``name`` with an optional oracle SQL."""

    def wrap(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap
