"""Where query modules leave their queries and SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triagelake.session import ship

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def shipped(f: Query) -> Query:
    """f, with the package sent to the Python workers first."""

    @functools.wraps(f)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return f(spark, folder)

    return run


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL it must equal."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is there already")
        _QUERIES[name] = shipped(f)
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from triagelake.plans import catalog  # noqa: F401  fills the registry

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _SQL
