"""Where queries are registered: name -> (Spark query, DuckDB statement or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql is what DuckDB is to answer alike."""

    def keep(f: Query) -> Query:
        if name in REGISTERED:
            raise ValueError(f"{name} is registered twice")
        REGISTERED[name] = f, sql
        return f

    return keep
