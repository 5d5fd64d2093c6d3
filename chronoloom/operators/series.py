"""Window functions over the time axis of a long panel: item, channel, t, y (null where missing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SERIES = ["item", "channel"]


def along() -> W:
    return W.partitionBy(*SERIES).orderBy("t")


def so_far() -> W:
    return along().rowsBetween(W.unboundedPreceding, 0)


def to_come() -> W:
    return along().rowsBetween(0, W.unboundedFollowing)


def forward_fill(panel: DataFrame, value: str = "y", out: str = "filled") -> DataFrame:
    """The last observed value; before the first, that one; 0 where there is none."""
    whole = along().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return panel.withColumn(out, F.coalesce(F.last(value, True).over(so_far()), F.first(value, True).over(whole), F.lit(0.0)))


def interpolate(panel: DataFrame, value: str = "y", out: str = "filled") -> DataFrame:
    """Linear between observed values, the nearest one beyond them; 0 where there is none."""
    at = F.when(F.col(value).isNotNull(), F.col("t"))
    a, b = F.last(value, True).over(so_far()), F.first(value, True).over(to_come())
    ta, tb = F.last(at, True).over(so_far()), F.first(at, True).over(to_come())
    blend = F.when(ta == tb, a).otherwise(a + (b - a) * (F.col("t") - ta) / (tb - ta))
    return panel.withColumn(out, F.coalesce(blend, a, b, F.lit(0.0)))


def seasonal_difference(panel: DataFrame, m: int, value: str = "y", out: str = "diff") -> DataFrame:
    """y - y of m steps before, where both are observed."""
    return panel.withColumn(out, F.col(value) - F.lag(value, m).over(along()))


def seasonal_scales(panel: DataFrame, m: int) -> DataFrame:
    """Mean absolute and root mean square seasonal differences of each series; null where there is none or it is zero."""
    d = seasonal_difference(panel, m)
    return d.groupBy(*SERIES).agg(F.nullif(F.avg(F.abs("diff")), F.lit(0.0)).alias("mase_scale"), F.nullif(F.sqrt(F.avg(F.col("diff") * F.col("diff"))), F.lit(0.0)).alias("msse_scale"), F.count("diff").alias("pairs"))


def prefix_scales(panel: DataFrame, m: int) -> DataFrame:
    """The same at every origin, from the pairs that end before it: item, channel, origin, mase_scale, msse_scale."""
    d = seasonal_difference(panel, m)
    running = lambda c: F.sum(c).over(so_far())
    n = F.count("diff").over(so_far())
    mase, msse = F.try_divide(running(F.abs("diff")), n), F.sqrt(F.try_divide(running(F.col("diff") * F.col("diff")), n))
    return d.select(*SERIES, (F.col("t") + 1).alias("origin"), F.nullif(mase, F.lit(0.0)).alias("mase_scale"), F.nullif(msse, F.lit(0.0)).alias("msse_scale"))


def audit_counters(panel: DataFrame) -> DataFrame:
    """Running counts of NaN (or null), +inf, -inf and changes of value: t, nan_before, posinf_before, neginf_before, changes_before (of steps up to t)."""
    y = F.col("y")
    nan = F.coalesce(F.isnan(y), F.lit(True)) | y.isNull()
    before = F.lag("y").over(along())
    change = (F.col("t") > 0) & ~before.eqNullSafe(y)
    run = lambda c: F.sum(c.cast("long")).over(so_far())
    return panel.withColumn("_c", change).select(*SERIES, "t", run(nan).alias("nan_upto"), run(F.coalesce(y == float("inf"), F.lit(False))).alias("posinf_upto"), run(F.coalesce(y == -float("inf"), F.lit(False))).alias("neginf_upto"), F.sum(F.col("_c").cast("long")).over(so_far()).alias("changes_upto"))


def rolling_median_iqr(panel: DataFrame, width: int, value: str = "filled") -> DataFrame:
    """Centred rolling median and interquartile range; an even width reaches one step further back."""
    frame = along().rowsBetween(-(width // 2), (width - 1) // 2)
    q = lambda p: F.percentile(value, F.lit(p)).over(frame)
    return panel.withColumn("median", q(0.5)).withColumn("iqr", q(0.75) - q(0.25))


def regular(panel: DataFrame, step: int = 1) -> DataFrame:
    """Rows for every step between a series' first and last; those that were missing have no value."""
    ends = panel.groupBy(*SERIES).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return ends.select(*SERIES, F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("t")).join(panel, [*SERIES, "t"], "left")


def anchor_weekday(times: DataFrame, group: list[str], time: str = "ts") -> DataFrame:
    """The commonest day of the week (1 = Sunday; ties: the first) of each group."""
    counted = times.groupBy(*group, F.dayofweek(time).alias("weekday")).count()
    return counted.groupBy(*group).agg(F.max(F.struct("count", (-F.col("weekday")).alias("d"))).alias("m")).select(*group, (-F.col("m.d")).cast("int").alias("weekday"))


def constant_gap(panel: DataFrame, time: str = "t") -> DataFrame:
    """Whether a series' steps are all the same, and the step if they are."""
    gaps = panel.where(F.col("y").isNotNull()).withColumn("gap", F.col(time) - F.lag(time).over(along()))
    agg = gaps.groupBy(*SERIES).agg(F.countDistinct("gap").alias("gaps"), F.min("gap").alias("step"))
    return agg.select(*SERIES, (F.col("gaps") == 1).alias("regular"), F.when(F.col("gaps") == 1, F.col("step")).alias("step"))


def blocks(panel: DataFrame, number: Column | int) -> DataFrame:
    """Chronological blocks of nearly equal length, the first ones longer by one."""
    return panel.withColumn("block", F.ntile(number).over(along()))


def first_difference(panel: DataFrame, value: str = "filled") -> DataFrame:
    return panel.withColumn("diff1", F.col(value) - F.lag(value).over(along()))


def autocorrelation(panel: DataFrame, value: str = "filled", lags: int = 10) -> DataFrame:
    """acf1..acfN, each sum of products of deviations over (n - k) times the population variance, and the sum of squares; null under 11 steps or variance 1e-8."""
    whole = W.partitionBy(*SERIES)
    d = panel.where(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.avg(value).over(whole))
    for k in range(1, lags + 1):
        d = d.withColumn(f"_l{k}", F.lag("_d", k).over(along()))
    n, var = F.count("*"), F.var_pop(value)
    good = (n >= 11) & (var >= 1e-8)
    acf = [F.when(good, F.sum(F.col("_d") * F.col(f"_l{k}")) / ((n - k) * var)).alias(f"acf{k}") for k in range(1, lags + 1)]
    out = d.groupBy(*SERIES).agg(n.alias("n"), *acf)
    squares = sum((F.col(f"acf{k}") * F.col(f"acf{k}") for k in range(2, lags + 1)), F.col("acf1") * F.col("acf1"))
    return out.withColumn("acf10", squares)


def cycle_correlation(panel: DataFrame, m: int, value: str = "filled") -> DataFrame:
    """Mean pairwise correlation of whole cycles of m steps: with unit vectors u of the cycles, (|sum u|^2 - c) / (c (c - 1))."""
    n = F.count("*").over(W.partitionBy(*SERIES))
    whole = panel.withColumn("_n", n).withColumn("cycle", F.floor(F.col("t") / m)).where(F.col("cycle") < F.floor(F.col("_n") / m))
    per = W.partitionBy(*SERIES, "cycle")
    d = whole.withColumn("_d", F.col(value) - F.avg(value).over(per)).withColumn("_norm", F.sqrt(F.sum(F.col("_d") * F.col("_d")).over(per)))
    live = d.where(F.col("_norm") > 1e-8)
    sums = live.groupBy(*SERIES, F.pmod("t", F.lit(m)).alias("phase")).agg(F.sum(F.col("_d") / F.col("_norm")).alias("s"), F.countDistinct("cycle").alias("c"))
    out = sums.groupBy(*SERIES).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("c").alias("cycles"))
    return out.select(*SERIES, "cycles", F.when(F.col("cycles") >= 2, (F.col("ss") - F.col("cycles")) / (F.col("cycles") * (F.col("cycles") - 1))).alias("seasonal_corr"))


def last_rows(panel: DataFrame, n: int) -> DataFrame:
    newest = F.row_number().over(W.partitionBy(*SERIES).orderBy(F.desc("t")))
    return panel.withColumn("_r", newest).where(F.col("_r") <= n).drop("_r")


def arrays(panel: DataFrame, value: str = "y") -> DataFrame:
    """item, channel, values: a row for each series, its values in time order, nulls kept."""
    made = panel.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("t", value))).alias("v"))
    return made.select(*SERIES, F.transform("v", lambda x: x[value]).alias("values"))
