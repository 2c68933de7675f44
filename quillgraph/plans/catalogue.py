"""Queries of the core for ``__spark_entry__``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.plans import change_queries, graph_queries, reference_queries, report_queries, retrieval_queries, text_queries, vault_queries

_MODULES = (reference_queries, vault_queries, text_queries, retrieval_queries, graph_queries, report_queries, change_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The query that the smoke check runs."""
    return QUERIES["p3_report"](spark, d)
