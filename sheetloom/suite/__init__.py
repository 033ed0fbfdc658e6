"""Queries over the test tables, each with the same question as plain SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sheetloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL twin."""

    def add(function: Query) -> Query:
        @wraps(function)
        def tuned(spark: SparkSession, folder: str) -> DataFrame:
            return function(tune(spark), folder)

        QUERIES[function.__name__] = tuned
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def load_all() -> None:
    from sheetloom.suite import changes, files, grids, guards, profiles, quality, sql_surface  # noqa: F401
