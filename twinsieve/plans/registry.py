"""Registry of the queries and of the SQL each one is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if key in QUERIES:
            raise KeyError(f"query registered twice: {key}")
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return run

    return add
