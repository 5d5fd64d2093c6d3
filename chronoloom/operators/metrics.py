"""Seasonal-naive forecasts, the evaluation grid and forecast metrics, on long rows.

Windows are keyed by item, channel and window; h counts forecast steps from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import SERIES, along, forward_fill, seasonal_difference, so_far

WINDOW = [*SERIES, "window"]
#: Default quantile levels.
LEVELS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def seasonal_naive(filled: DataFrame, windows: DataFrame, m: int, horizon: int) -> DataFrame:
    """item, channel, window, h, yhat: the last season before each origin, repeated; filled has item, channel, t, filled."""
    n = F.least(F.lit(m), F.col("origin"))
    steps = windows.select("item", "window", "origin", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("h"))
    steps = steps.withColumn("t", F.col("origin") - n + F.pmod(F.col("h"), n))
    return steps.join(filled.select(*SERIES, "t", F.col("filled").alias("yhat")), ["item", "t"]).select(*WINDOW, "origin", "h", "yhat")


def naive_quantiles(points: DataFrame, sigmas: DataFrame, m: int, levels: list[float] = LEVELS) -> DataFrame:
    """Gaussian bands around seasonal-naive points: sigma (of a series' seasonal differences) times the root of the seasons ahead times the normal quantile."""
    from statistics import NormalDist

    z = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.lit(NormalDist().inv_cdf(q)).alias("z")) for q in levels])).alias("q")
    rows = points.join(sigmas, SERIES).select("*", z)
    seasons = F.floor(F.col("h") / m) + 1
    return rows.select(*WINDOW, "h", F.col("q.quantile").alias("quantile"), (F.col("yhat") + F.col("q.z") * F.col("sigma") * F.sqrt(seasons)).alias("yhat"))


def interval_levels(levels: list[float]) -> list[int]:
    """The central intervals, in per cent, whose ends are the quantile levels."""
    return sorted({round(200 * (max(q, 1 - q) - 0.5)) for q in levels if q != 0.5})


def actuals(panel: DataFrame, windows: DataFrame, horizon: int) -> DataFrame:
    """item, channel, window, h, y of every window's target."""
    steps = windows.select("item", "window", "origin", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("h")).withColumn("t", F.col("origin") + F.col("h"))
    return steps.join(panel, ["item", "t"]).select(*WINDOW, "origin", "h", "y")


def strided_cells(panel: DataFrame, m: int, horizon: int, first: int, step: int, dates: int, other: int) -> DataFrame:
    """item, channel, window, origin, h, y, yhat, other, scale of windows from first on, a step apart, in one pass along each series and without a join.

    yhat is the seasonal-naive forecast, other the filled value of so many steps before, scale the MASE scale at the
    origin.  The panel has every step of its series; a horizon beyond a season, or an origin within the first, is an error.
    """
    if not 0 < horizon <= m <= first or other > first:
        raise ValueError("the horizon must lie within a season, and the season and the other step before the first origin")
    lag = lambda c, n: F.lag(c, n).over(along())
    d = seasonal_difference(forward_fill(panel), m)
    mase = F.try_divide(F.sum(F.abs("diff")).over(so_far()), F.count("diff").over(so_far()))
    d = d.withColumn("_s", F.nullif(mase, F.lit(0.0)))
    past = F.array(*[lag("_s", h + 1) for h in range(horizon)])
    d = d.select(*SERIES, "t", "y", lag("filled", m).alias("yhat"), lag("filled", other).alias("other"), past.alias("_s")).where(F.col("t") >= first)
    hours = F.sequence(F.pmod(F.col("t") - first, F.lit(step)).cast("int"), F.lit(horizon - 1), F.lit(step))
    begun = F.pmod(F.col("t") - first, F.lit(step)) < horizon
    cells = d.where(begun).withColumn("h", F.explode(hours)).withColumn("origin", F.col("t") - F.col("h"))
    cells = cells.where((F.col("origin") >= first) & (F.col("origin") <= first + step * (dates - 1)))
    window = ((F.col("origin") - first) / step).cast("int")
    return cells.select(*SERIES, window.alias("window"), "origin", "h", "y", "yhat", "other", F.get("_s", F.col("h")).alias("scale"))


def evaluation_grid(cells: DataFrame) -> DataFrame:
    """Windows with their support and whether they are in the grid: the naive forecast (yhat) is finite wherever there is a target, and its scaled error is defined; cells has y, yhat, scale by h."""
    good = F.col("y").isNotNull()
    agg = cells.groupBy(*WINDOW).agg(F.count_if(good).alias("support"), F.coalesce(F.bool_and(F.when(good, F.col("yhat").isNotNull())), F.lit(False)).alias("naive_finite"), F.max("scale").alias("scale"))
    return agg.select(*WINDOW, "support", (F.col("naive_finite") & F.col("scale").isNotNull() & (F.col("support") > 0)).alias("in_grid"))


def window_metrics(cells: DataFrame) -> DataFrame:
    """MSE, MAE, RMSE, MAPE, sMAPE, MASE and ND of each window; cells has y (null: not in the target), yhat, scale.  A null forecast of a target is an error."""
    y, f = F.col("y"), F.col("yhat")
    f = F.when(y.isNotNull() & f.isNull(), F.raise_error(F.lit("a forecast is missing inside the grid")).cast("double")).otherwise(f)
    cells = cells.where(y.isNotNull()).withColumn("_e", F.abs(y - f))
    e, size = F.col("_e"), F.abs(y) + F.abs(F.col("yhat"))
    mae = F.avg(e)
    return cells.groupBy(*WINDOW).agg(
        F.avg(e * e).alias("mse"),
        mae.alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.when(y != 0, e / F.abs(F.nullif(y, F.lit(0.0))))).alias("mape"),
        F.avg(F.when(size > 0, 2 * e / F.nullif(size, F.lit(0.0))).otherwise(0.0)).alias("smape"),
        F.try_divide(mae, F.max("scale")).alias("mase"),
        F.try_divide(F.sum(e), F.nullif(F.sum(F.abs(y)), F.lit(0.0))).alias("nd"),
    )


def crps(cells: DataFrame) -> DataFrame:
    """Mean over quantiles of the weighted quantile losses of each window; cells has y, quantile, yhat."""
    y, f, q = F.col("y"), F.col("yhat"), F.col("quantile")
    loss = 2 * F.abs((y - f) * ((f >= y).cast("double") - q))
    per = cells.where(y.isNotNull()).groupBy(*WINDOW, "quantile").agg(F.sum(loss).alias("loss"), F.sum(F.abs(y)).alias("size"))
    return per.groupBy(*WINDOW).agg(F.avg(F.try_divide("loss", F.nullif(F.col("size"), F.lit(0.0)))).alias("crps"))


def metric_summary(metrics: DataFrame, names: list[str]) -> DataFrame:
    """metric, mean (of defined values), defined, cells."""
    rows = metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("m")).select("m.*")
    return rows.groupBy("metric").agg(F.avg("v").alias("mean"), F.count("v").alias("defined"), F.count("*").alias("cells"))


def scale_factors(predictions: DataFrame, group: list[str], value: str = "yhat") -> DataFrame:
    from ..functions.columns import prediction_scale

    return predictions.groupBy(*group).agg(F.max(F.abs(value)).alias("largest")).withColumn("factor", prediction_scale(F.col("largest")))
