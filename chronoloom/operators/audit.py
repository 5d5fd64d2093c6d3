"""Window audits: non-finite values and constant stretches, by range aggregates over a long panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import kind, position_time
from .series import SERIES, along

COUNTS = ["channel_windows", "value_count", "finite_count", "nan_count", "posinf_count", "neginf_count", "nonfinite_windows", "constant_windows", "all_nonfinite_windows"]


def interval_counts(panel: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each window and channel; windows has keys, item, start, stop.

    A window's steps are exploded into an equi join with the panel, so that its work is its length,
    not the panel's.  Constant: all finite and no step differs from the one before it in the window.
    """
    before = F.lag("y").over(along())
    p = panel.withColumn("_k", kind(F.col("y"))).withColumn("_same", before.eqNullSafe(F.col("y")))
    steps = windows.select(*keys, "item", "start", "stop", F.explode(F.sequence("start", F.col("stop") - 1)).alias("t"))
    rows = steps.join(p, ["item", "t"])
    n = F.count("*")
    of = lambda k: F.count_if(F.col("_k") == k)
    broken = F.count_if((F.col("t") > F.col("start")) & ~F.col("_same"))
    finite = of("finite")
    return rows.groupBy(*keys, *SERIES, "start", "stop").agg(
        F.lit(1).alias("channel_windows"),
        n.alias("value_count"),
        finite.alias("finite_count"),
        of("nan").alias("nan_count"),
        of("posinf").alias("posinf_count"),
        of("neginf").alias("neginf_count"),
        (finite < n).cast("int").alias("nonfinite_windows"),
        ((finite == n) & (broken == 0)).cast("int").alias("constant_windows"),
        (finite == 0).cast("int").alias("all_nonfinite_windows"),
    )


def rollup(counts: DataFrame, dataset: str, term: str) -> DataFrame:
    """Sums by (dataset, term), by dataset (term 'all') and in all (both 'all')."""
    grouped = counts.rollup(dataset, term).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return grouped.select(F.coalesce(dataset, F.lit("all")).alias(dataset), F.coalesce(term, F.lit("all")).alias(term), *COUNTS)


def nonfinite_positions(panel: DataFrame, start: str, seconds: int) -> DataFrame:
    """item, channel, t, ts, kind of every value that is not finite."""
    found = panel.withColumn("kind", kind(F.col("y"))).where("kind <> 'finite'")
    return found.select(*SERIES, "t", position_time(F.lit(start), seconds, F.col("t")).alias("ts"), "kind")


def events(counts: DataFrame) -> DataFrame:
    """Windows with non-finite values or none that differ."""
    return counts.where("nonfinite_windows = 1 or constant_windows = 1")
