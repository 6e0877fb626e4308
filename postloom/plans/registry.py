"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from postloom.plans.views import view_ctes
from postloom.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = (), ctes: str = "") -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the views and the extra ``ctes`` before it."""

    def wrap(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(use_utc(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            items = [part for part in (view_ctes(list(views), "duckdb"), ctes.strip()) if part]
            ORACLES[name] = (f"WITH RECURSIVE {', '.join(items)}\n" if items else "") + sql.strip()
        return build

    return wrap
