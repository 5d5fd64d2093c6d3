"""Evaluation of forecasts: one job from a forecaster, or from a table of point forecasts, to metrics and a summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forecast, metrics

METRICS = ["mse", "mae", "rmse", "mape", "smape", "mase", "nd"]


def evaluate_points(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics of each window, summary) of rows (item, channel, window, target, yhat, vanilla, scale).

    A forecast with a value that is not finite is replaced by vanilla as a whole, and counted; a window without a
    finite forecast by either is an error where it has a target.  The summary has a row for each metric, with the
    windows that fell back and their share of those that have a target.
    """
    finite = F.coalesce(F.forall("yhat", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    used = made.withColumn("fallback", ~finite).withColumn("yhat", F.when(finite, F.col("yhat")).otherwise(F.col("vanilla")))
    long = used.select(*metrics.WINDOW, "scale", "fallback", F.posexplode(F.arrays_zip(F.col("target").alias("y"), F.col("yhat").alias("f"))).alias("h", "z"))
    long = long.select(*metrics.WINDOW, "scale", "fallback", "h", F.col("z.y").alias("y"), F.col("z.f").alias("yhat"))
    cells = metrics.window_metrics(long).join(used.select(*metrics.WINDOW, "fallback"), metrics.WINDOW)
    counts = cells.agg(F.count_if("fallback").alias("fallback"), F.count("*").alias("eligible"))
    summary = metrics.metric_summary(cells, METRICS).crossJoin(F.broadcast(counts))  # one row
    return cells, summary.withColumn("fallback_rate", F.try_divide("fallback", "eligible"))


def evaluate(make: Callable[[], forecast.Forecaster], windows: DataFrame, horizon: int, vanilla: Callable[[], forecast.Forecaster], retrieved: str | None = None) -> tuple[DataFrame, DataFrame]:
    """evaluate_points of a forecaster on windows (item, channel, window, context, target, scale), falling back on the forecaster vanilla."""
    keys = metrics.WINDOW
    made = forecast.forecast(windows, make, horizon, keys, retrieved)
    plain = forecast.forecast(windows, vanilla, horizon, keys).withColumnRenamed("yhat", "vanilla")
    return evaluate_points(windows.select(*keys, "target", "scale").join(made, keys).join(plain, keys))
