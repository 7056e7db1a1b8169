"""Registered queries: name -> Spark callable, and name -> the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Callable) -> Callable:
        from foliospark.plans.fixtures import Tables

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def load_all() -> None:
    from foliospark.plans import (  # noqa: F401
        assembly_queries,
        diagram_queries,
        expression_queries,
        metric_queries,
        page_queries,
        render_queries,
        sample_queries,
        source_queries,
        stream_queries,
        table_queries,
    )
