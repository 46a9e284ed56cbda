"""Registry of named queries over the test tables, each with its SQL oracle.

A query is a callable ``(spark, sf_dir) -> DataFrame``; its oracle is an
ANSI SQL string DuckDB runs over the same tables (registered as views), with
identical output column names. Queries without a SQL form register no oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    note: str = ""


_QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None, note: str = ""):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = Query(name, fn, sql.strip() if sql else None, note)
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules fills the registry.
    from ledgerline.plans import (  # noqa: F401
        q_sources, q_questions, q_quality, q_summary, q_joins, q_models, q_anomaly, q_forecast,
        q_alerts, q_streams)


def all_queries() -> dict[str, Query]:
    _load_all()
    if "SRC9" not in _QUERIES:  # its SQL is built from the BQ9 oracle
        from ledgerline.plans import q_sources
        _QUERIES["SRC9"] = Query("SRC9", q_sources.src9, q_sources._src9_sql(_QUERIES["BQ9"].sql))
    return dict(_QUERIES)
