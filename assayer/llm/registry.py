"""The queries of this folder, with reference SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MODULES = ("queries",)


def query(key: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


def load():
    """(queries, reference SQL)."""
    for name in MODULES:
        import_module(f"{__package__}.{name}")
    return QUERIES, SQL
