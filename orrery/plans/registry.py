"""The registered queries: name -> (Spark query, DuckDB SQL for the same rows or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: put a query, and the SQL it is held against, on the list."""

    def put(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return put
