"""Where queries over the logical tables are registered, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weir.bindings import TABLES, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str):
    """Registers a query whose parameters are logical tables, with its SQL."""

    def put(f):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        QUERIES[f.__name__] = lambda spark, d: f(*(TABLES[n](spark, d) for n in names))
        ORACLES[f.__name__] = with_tables(sql)
        return f

    return put
