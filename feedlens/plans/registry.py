"""All registered queries and their SQL twins, by survey id."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "FLAGSHIP_canonical_page"
MODULES = ("articles", "reports", "scalars", "rules", "sinks", "sources", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"feedlens.plans.{name}")
