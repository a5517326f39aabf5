"""Registered queries: each pairs a Spark job over the given tables with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_MODULES = ["text", "index", "vectors", "search", "evaluation", "usage", "ingest", "admin", "answers", "streams"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def load_all() -> None:
    import pathlib

    here = pathlib.Path(__file__).parent
    for module in _MODULES:
        if (here / f"{module}.py").exists():
            importlib.import_module(f"answerloom.registry.{module}")
