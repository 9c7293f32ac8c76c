"""Registry of the engine's queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame callable, and its DuckDB SQL if SQL can express it."""

    def register(f):
        _QUERIES[name] = f
        if oracle:
            _ORACLE[name] = oracle
        return f

    return register


def _load() -> None:
    import porelake.plans  # noqa: F401  registers every query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
