"""All queries outside the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandframe.plans import column_queries, file_queries, graph_queries, group_queries, kernel_queries, pair_queries, skew_queries, source_queries

MODULES = [skew_queries, column_queries, group_queries, pair_queries, graph_queries, kernel_queries, source_queries, file_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
