"""Queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *names: str):
    """Register a query, with its SQL over the fixtures named."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_fixtures(sql, *names) if names else sql
        return f

    return add
