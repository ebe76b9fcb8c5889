"""Every registered query of the library with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import cte, fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, fixtures: str, sql: str | None = None):
    """Register a function of fixture tables (named, in order) as a query; sql reads the same fixtures."""
    names = fixtures.split()

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[fixture(spark, sf_dir, n) for n in names])
        if sql:
            SQL[name] = f"WITH {cte(*dict.fromkeys(names))} {sql.strip()}"
        return f

    return put


from . import basic, interval, more, wider  # noqa: E402,F401
