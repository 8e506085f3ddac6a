"""Registered queries: a name, a Spark callable and, where it exists, the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

RUNS: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in RUNS:
            raise ValueError(f"query {name} is registered twice")
        RUNS[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register
