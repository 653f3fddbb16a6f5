"""Named queries, each with the inventory ids it covers and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamella.sources.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Registers f(views) -> DataFrame. covers: ids, blank-separated."""

    def register(f: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = lambda spark, folder: f(Views(spark, folder))
        COVERS[name] = covers.split()
        if sql is not None:
            SQL[name] = with_views(sql)
        return f

    return register
