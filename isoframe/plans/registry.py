"""Registered queries of the library and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isoframe.plans import clusters, convert, core, selection, splicing

MODULES = [core, splicing, convert, selection, clusters]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant events by comparison and event type."""
    return core.landscape(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
