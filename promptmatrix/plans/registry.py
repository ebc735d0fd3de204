"""Where queries and their SQL twins are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from promptmatrix.plans import demo

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, base: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``base`` puts the tables of the demonstration run before its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = (demo.SQL if base else "") + sql
        return f

    return register
