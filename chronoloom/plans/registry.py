"""Registers queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6
#: Added before rounding, so that sums in another order do not round a tie the other way.
TIES = 1e-9


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name; its doubles are rounded, as round() does in the SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(frame: DataFrame) -> DataFrame:
    return frame.select(*[(F.round(F.col(f"`{f.name}`") + TIES, DIGITS) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in frame.schema.fields])


def r(expression: str) -> str:
    return f"round({expression} + {TIES}, {DIGITS}) + 0.0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
