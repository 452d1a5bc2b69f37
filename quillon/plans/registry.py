"""Registry of the queries over the fixed tables and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "rt28_recommend"


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that gives the same rows where there is one."""

    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return keep
