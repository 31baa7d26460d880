"""Registry of named queries and their SQL twins."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import sql as _sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: tuple | str = (), sql: str | None = None):
    """Register a query; ``sql`` is its twin over the named views."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _sql(sql, *((views,) if isinstance(views, str) else views))
        return fn
    return add
