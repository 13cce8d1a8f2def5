"""All queries over the driver's tables, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``, with its oracle where SQL can express it."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLE[name] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    from kvartal.plans import catalogue  # noqa: F401  (registers on import)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from kvartal.plans import catalogue  # noqa: F401

    return dict(_ORACLE)
