"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geotally.plans.base import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of ``Tables`` as a query; ``sql`` is DuckDB SQL with the same rows."""

    def put(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return f

    return put
