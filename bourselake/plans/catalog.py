"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bourselake.plans.marts import Marts
from bourselake.plans.oracle import with_views

QUERIES: dict[str, Callable[[Marts], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(marts) -> DataFrame``; ``sql`` reads the named views."""

    def add(fn: Callable[[Marts], DataFrame]) -> Callable[[Marts], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return add


def load() -> None:
    """Import every catalogue module once."""
    from bourselake.plans import (  # noqa: F401
        catalog_access,
        catalog_merge,
        catalog_quality,
        catalog_scalars,
        catalog_screen,
        catalog_series,
        catalog_sources,
        catalog_streaming,
        catalog_valuation,
    )


def bound_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {n: (lambda spark, path, _fn=fn: _fn(Marts(spark, path))) for n, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)
