"""Query registry: name -> (Spark builder, optional DuckDB oracle SQL).

Output convention for registered queries (so Spark and DuckDB results compare
value for value): money and ratios as DOUBLE, counts as BIGINT, calendar dates
as ISO ``yyyy-MM-dd`` strings, timestamps unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(QUERIES)


def all_oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)


def _load() -> None:
    # importing the modules registers their queries
    from creditline.plans import q_core, q_extra, q_geo, q_keyed, q_more  # noqa: F401
