"""The registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factgraph.plans import bridge
from factgraph.plans.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of Tables as a query, with its SQL over the bridge views."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = bridge.duckdb(sql)
        return f

    return add


def in_list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in values) + ")"
