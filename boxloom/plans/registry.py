"""All registered queries and their SQL twins. Each query is a function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function, which gets the fixture tables of an sf_dir."""

    def add(build):
        from .fixtures import Tables

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return add


for _part in ("geometry", "filters_joins", "fusion", "metrics", "frames_stats", "responses", "formats", "streams"):
    import_module(f"boxloom.plans.{_part}_queries")
