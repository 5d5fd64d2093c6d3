"""This library's own queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import model_queries, report_queries, series_queries  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the seasonal-naive forecast of every official window."""
    return QUERIES["g1_window_metrics"](spark, sf_dir)
