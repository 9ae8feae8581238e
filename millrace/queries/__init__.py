"""The library's queries by name, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None) -> Callable[[Run], Run]:
    """Register a function of (spark, folder) under its name, with its SQL."""

    def put(run: Run) -> Run:
        key = name or run.__name__
        QUERIES[key], SQL[key] = run, " ".join(sql.split())
        return run

    return put


def queries() -> dict[str, Run]:
    from millrace.queries import operators, tpch  # noqa: F401  they register themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
