"""Names of the registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.plans import ingest_queries, linkage_queries

_MODULES = (linkage_queries, ingest_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage_queries.retained_items(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
