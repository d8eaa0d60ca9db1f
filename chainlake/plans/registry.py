"""Named queries: each maps ``(spark, sf_dir) -> DataFrame`` and, where SQL
can state it, carries a DuckDB oracle over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import oracle

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import q_ingest, q_sink, q_analytics, q_catalog, q_service, q_stream, q_layout  # noqa: F401
