"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import tables as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: What a bounded answer shows; part of the queries' meaning.
TOP_K = 10


def query(sql: str | None = None, views: bool = True):
    """Registers a query; its SQL is put behind the shared views: as further ones if it begins with a comma."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {D.VIEWS.strip()}\n{sql.strip()}" if views else sql.strip()
        return f

    return add
