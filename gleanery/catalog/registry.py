"""Registry of runnable queries and their SQL cross-checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.catalog import fixtures

Query = Callable[[SparkSession, str], DataFrame]
Views = Callable[[str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Views], DataFrame]], Query]:
    """Register ``fn(view)``, where ``view(name)`` gives an input DataFrame."""

    def wrap(fn: Callable[[Views], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda view_name: fixtures.view(spark, sf_dir, view_name))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = fixtures.oracle(sql)
        return run

    return wrap


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from gleanery.catalog import (  # noqa: F401
        chain_queries, context_queries, crawl_queries, extract_queries, history_queries, ingest_queries,
        merge_queries, retrieval_queries, streaming_queries, workspace_queries,
    )

    return QUERIES, ORACLES
