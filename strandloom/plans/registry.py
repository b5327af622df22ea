"""Where the query modules enter their queries, the SQL with the same rows, and the IDs of the operator inventory each covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(ids: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = ids
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
