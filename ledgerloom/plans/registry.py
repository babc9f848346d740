"""All queries over the reference tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import queries_layout, queries_retrieval, queries_text

_MODULES = (queries_retrieval, queries_text, queries_layout)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Exact top-k over the stored vectors."""
    return queries_retrieval.dense_topk(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
