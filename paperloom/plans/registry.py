"""All queries of the core library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.plans import graph_queries, payload_queries, ranking_queries, record_queries, report_queries, search_queries, text_queries

_MODULES = [record_queries, text_queries, ranking_queries, graph_queries, report_queries, search_queries, payload_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["hybrid_retrieval"](spark, sf_dir)
