"""Registry of queries over the driver tables and of their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its oracle."""

    def add(f: Query) -> Query:
        _queries[name] = f
        if oracle is not None:
            _oracles[name] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


from .plans import agenda_queries, coverage_queries, document_queries, evening_queries, extract_queries, festival_queries, listing_queries, pipeline_queries, reader_queries, staging_queries, store_queries, web_queries  # noqa: E402,F401  they register their queries
