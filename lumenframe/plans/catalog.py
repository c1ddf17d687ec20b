"""Every registered query of the library proper and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import queries_models, queries_multivariate, queries_ranks, queries_rows, queries_scalar, queries_summaries, queries_text, queries_verbs  # noqa: F401
from .registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly revenue by market segment with conditional aggregates."""
    return QUERIES["summarize_group_quarter"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
