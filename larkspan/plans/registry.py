"""Where every query of the engine is registered, beside the DuckDB SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspan.sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(views: str = "", sql: str | None = None) -> Callable:
    """Registers a query (spark, sf_dir) under its name; ``sql`` goes on behind the views that it names."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = A.with_views(views, sql) if views else sql
        return f

    return add
