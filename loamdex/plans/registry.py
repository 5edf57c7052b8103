"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_LITERALS: dict[str, tuple[Query, str]] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers the decorated function under `name`."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return add


def literal(name: str, oracle: str) -> Callable[[Query], Query]:
    """Keeps a case of typed rows and its SQL for the tests; it is no query."""

    def add(f: Query) -> Query:
        _LITERALS[name] = (f, oracle)
        return f

    return add


def literals() -> dict[str, tuple[Query, str]]:
    load()
    return _LITERALS


def queries() -> dict[str, Query]:
    load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return _ORACLES


def load() -> None:
    """Imports the modules whose queries register themselves."""
    from loamdex.plans import data_queries, index_queries, more_queries, search_queries, table_queries, text_queries  # noqa: F401
