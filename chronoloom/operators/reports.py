"""Reports: averages in levels, scaled errors, correlations, run selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def require_unique(frame: DataFrame, keys: list[str]) -> DataFrame:
    """frame, or an error when it is read, if a key has more than one row."""
    n = F.count("*").over(W.partitionBy(*keys))
    first = frame.columns[0]
    checked = frame.withColumn("_n", n)
    return checked.withColumn(first, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("a key has several rows: "), F.to_json(F.struct(*keys)))).cast(frame.schema[first].dataType)).otherwise(F.col(first))).drop("_n")


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def scaled_error(results: DataFrame, baseline: DataFrame, keys: list[str], value: str = "mase") -> DataFrame:
    """results with scaled: value over the baseline's of the task; a missing, repeated or non-positive baseline is an error."""
    base = require_unique(baseline.select(*keys, F.col(value).alias("_base")), keys)
    joined = results.join(base, keys, "left")
    good = F.when(F.col("_base").isNull() | (F.col("_base") <= 0), F.raise_error(F.lit("a task has no positive baseline")).cast("double")).otherwise(F.col("_base"))
    return joined.withColumn("scaled", F.col(value) / good).drop("_base")


def scaled_within(results: DataFrame, baseline: Column, keys: list[str], value: str = "mase") -> DataFrame:
    """scaled_error by the one row of each task that is its baseline, read from the same rows: a baseline made apart may sum in another order, so that it is not its own equal."""
    task = W.partitionBy(*keys)
    given = F.when(baseline, F.col(value))
    alone = F.when(F.count_if(baseline).over(task) > 1, F.raise_error(F.concat(F.lit("a key has several rows: "), F.to_json(F.struct(*keys)))).cast("double")).otherwise(F.max(given).over(task))
    joined = results.withColumn("_base", alone)
    good = F.when(F.col("_base").isNull() | (F.col("_base") <= 0), F.raise_error(F.lit("a task has no positive baseline")).cast("double")).otherwise(F.col("_base"))
    return joined.withColumn("scaled", F.col(value) / good).drop("_base")


def missing_tasks(expected: DataFrame, methods: DataFrame, results: DataFrame) -> DataFrame:
    """(task, method) pairs without a result; both lists are a few names."""
    return expected.crossJoin(F.broadcast(methods)).join(results, [*expected.columns, *methods.columns], "left_anti")


def unequal_support(results: DataFrame, task: list[str], support: str) -> DataFrame:
    """Tasks whose methods were evaluated on different supports."""
    return results.groupBy(*task).agg(F.countDistinct(support).alias("supports")).where("supports > 1")


def effective(results: DataFrame, task: list[str], method: str, config: str, values: list[str], counts: list[str]) -> DataFrame:
    """Repeats averaged within a configuration, then configurations within a task and method; counts are summed."""

    def level(frame: DataFrame, keys: list[str]) -> DataFrame:
        return frame.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], *[F.sum(c).alias(c) for c in counts])

    return level(level(results, [*task, method, config]), [*task, method])


def geometric_mean(c: Column) -> Column:
    """0 if any value is 0."""
    return F.when(F.min(c) <= 0, 0.0).otherwise(F.exp(F.avg(F.when(c > 0, F.ln(F.nullif(c, F.lit(0.0)))))))


def method_summary(cells: DataFrame, method: str = "method") -> DataFrame:
    """Scaled and plain errors, time (only where every task is timed), fallbacks averaged and pooled; cells has dataset, mase, scaled, seconds, fallback, eligible."""
    n = F.count("*")
    return cells.groupBy(method).agg(
        geometric_mean(F.col("scaled")).alias("scaled_mase"),
        F.avg("mase").alias("mase"),
        F.when(F.count("seconds") == n, F.sum("seconds")).alias("seconds"),
        F.countDistinct("dataset").alias("datasets"),
        n.alias("tasks"),
        F.count("seconds").alias("timed_tasks"),
        F.count_if(F.col("fallback") > 0).alias("tasks_with_fallback"),
        F.avg(F.try_divide("fallback", "eligible")).alias("average_fallback_rate"),
        F.try_divide(F.sum("fallback"), F.nullif(F.sum("eligible"), F.lit(0))).alias("pooled_fallback_rate"),
    )


def selection_rates(selected: DataFrame, methods: DataFrame, rate: str = "rate") -> DataFrame:
    """method, rate_sum, tasks of every method, zeros where one was never selected."""
    agg = selected.groupBy("method").agg(F.sum(rate).alias("rate_sum"), F.count_if(F.col(rate) > 0).alias("tasks"))
    return methods.join(agg, "method", "left").select("method", F.coalesce("rate_sum", F.lit(0.0)).alias("rate_sum"), F.coalesce("tasks", F.lit(0)).alias("tasks"))


def correlation(x: str, y: str) -> Column:
    """Pearson's; null without variation."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks from 1, ties at their mean."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2


def spearman(rows: DataFrame, least: int = 3) -> DataFrame:
    """feature, model, rho, n; rows has feature, model, x, y; null under `least` rows or without variation."""
    good = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    r = good.withColumn("rx", average_rank("x", ["feature", "model"])).withColumn("ry", average_rank("y", ["feature", "model"]))
    agg = r.groupBy("feature", "model").agg(F.count("*").alias("n"), F.min("x").alias("_a"), F.max("x").alias("_b"), F.min("y").alias("_c"), F.max("y").alias("_d"), correlation("rx", "ry").alias("_r"))
    return agg.select("feature", "model", F.when((F.col("n") >= least) & (F.col("_a") < F.col("_b")) & (F.col("_c") < F.col("_d")), F.col("_r")).alias("rho"), "n")


def mean_absolute(correlations: DataFrame) -> DataFrame:
    return correlations.groupBy("feature").agg(F.avg(F.abs("rho")).alias("mean_absolute"))


def top_features(means: DataFrame, n: int) -> DataFrame:
    return means.orderBy(F.desc_nulls_last("mean_absolute"), "feature").limit(n)


def trend_lines(rows: DataFrame) -> DataFrame:
    """slope and intercept of y on x for each feature and model."""
    return rows.groupBy("feature", "model").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count("*").alias("n"))


def trend_svg(points: list[tuple[float, float]], slope: float | None, intercept: float | None, title: str, width: int = 320, height: int = 240) -> str:
    """A scatter plot with its line, as SVG; for a report's few points."""
    from xml.sax.saxutils import escape

    xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
    place = lambda v, lo, hi, size: 20 + (v - lo) / (hi - lo or 1) * (size - 40)
    px = lambda v: place(v, min(xs), max(xs), width)
    py = lambda v: height - place(v, min(ys), max(ys), height)
    marks = "".join(f'<circle cx="{px(x):.1f}" cy="{py(y):.1f}" r="3"/>' for x, y in points)
    line = "" if slope is None or intercept is None else f'<line x1="{px(min(xs)):.1f}" y1="{py(slope * min(xs) + intercept):.1f}" x2="{px(max(xs)):.1f}" y2="{py(slope * max(xs) + intercept):.1f}" stroke="red"/>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><title>{escape(title)}</title>{marks}{line}</svg>'


def timing_summary(times: DataFrame, keys: list[str]) -> DataFrame:
    p = lambda q: F.percentile("seconds", F.lit(q))
    return times.groupBy(*keys).agg(F.avg("seconds").alias("mean_s"), p(0.5).alias("median_s"), p(0.95).alias("p95_s"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"), F.count("*").alias("runs"))


def select_runs(runs: DataFrame, config_policy: str = "error", repeat_policy: str = "selected", filters: Column | None = None, values: list[str] | None = None) -> DataFrame:
    """Completed runs by policy; runs has identity, config, run, stamp, status, selected.

    Configurations of an identity: error (if several), distinct, latest, average.
    Repeats of a configuration: selected (else the latest), latest, distinct, average.
    average takes the mean of values and leaves out what tells the averaged apart (run, stamp and selected, and of
    configurations also config); without values it gives the runs to average, for effective to do it.
    """
    if config_policy not in ("error", "distinct", "latest", "average") or repeat_policy not in ("selected", "latest", "distinct", "average"):
        raise ValueError("no such policy")
    done = runs.where("status = 'completed'")
    done = done if filters is None else done.where(filters)
    if config_policy == "error":
        several = done.groupBy("identity").agg(F.countDistinct("config").alias("n")).where("n > 1")
        if several.limit(1).count():
            raise ValueError("several configurations match an identity")
    if config_policy == "latest":
        newest = W.partitionBy("identity").orderBy(F.desc("stamp"), F.desc("run"))
        done = done.withColumn("_c", F.first("config").over(newest)).where("config = _c").drop("_c")
    if repeat_policy in ("selected", "latest"):
        first = [F.desc("selected")] if repeat_policy == "selected" else []
        order = W.partitionBy("identity", "config").orderBy(*first, F.desc("stamp"), F.desc("run"))
        done = done.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    means = [F.avg(v).alias(v) for v in values or []]
    if values and repeat_policy == "average":
        done = done.groupBy("identity", "config").agg(*means)
    if values and config_policy == "average":
        done = done.groupBy("identity").agg(*means)
    return done


def inexact_matches(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with other than one row: what an exact match must not have."""
    return frame.groupBy(*keys).agg(F.count("*").alias("matches")).where("matches <> 1")


def exactly_one(frame: DataFrame, condition: Column) -> dict:
    """The only row that meets a condition; none or several are an error."""
    rows = frame.where(condition).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("no row matches" if not rows else "several rows match")
    return rows[0].asDict()


def reason_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"))


def balanced_sample(rows: DataFrame, series: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows, taken from the series in turns, in a seeded random order within each."""
    mixed = lambda by, *columns: F.md5(F.concat_ws("/", F.lit(by), *[F.col(c).cast("string") for c in columns]))
    turn = rows.withColumn("_turn", F.row_number().over(W.partitionBy(*series).orderBy(mixed(seed, key), key))).where(F.col("_turn") <= n)
    return turn.orderBy("_turn", mixed(seed + 1, *series), *series).limit(n).drop("_turn")
