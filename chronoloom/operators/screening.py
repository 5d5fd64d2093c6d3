"""Data-quality screening of series: checks, outliers, correlated variates, summaries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .series import SERIES, along, forward_fill, rolling_median_iqr

#: Fewest steps of a usable series by frequency.
LEAST_LENGTH = {"S": 3600, "T": 1440, "H": 168, "D": 90, "B": 60, "W": 52, "M": 36, "Q": 16, "A": 10}
MISSING, DOMINANCE, ENTROPY, P_VALUE, TRANSIENT, EXTREME, EXTREME_SHARE, CORRELATED = 0.2, 0.5, 0.1, 0.05, 3.0, 9.0, 0.05, 0.95


def basic_checks(panel: DataFrame, least_length: int, missing: float = MISSING) -> DataFrame:
    """item, channel, length, missing_rate, length_ok, missing_ok, monotonic."""
    p = panel.withColumn("_gap", F.col("t") - F.lag("t").over(along()))
    rate = F.avg(F.col("y").isNull().cast("int"))
    return p.groupBy(*SERIES).agg(F.count("*").alias("length"), rate.alias("missing_rate"), (F.count("*") >= least_length).alias("length_ok"), (rate <= missing).alias("missing_ok"), F.coalesce(F.min("_gap") > 0, F.lit(True)).alias("monotonic"))


def constancy(panel: DataFrame, value: str = "filled") -> DataFrame:
    """item, channel, dominance (share of the five commonest values), entropy (over its greatest), varied."""
    counts = panel.groupBy(*SERIES, value).count()
    w = W.partitionBy(*SERIES)
    p = counts.withColumn("p", F.col("count") / F.sum("count").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("count"), value))).withColumn("_k", F.count("*").over(w))
    agg = p.groupBy(*SERIES).agg(F.sum(F.when(F.col("_r") <= 5, F.col("p"))).alias("dominance"), F.when(F.max("_k") == 1, 0.0).otherwise(-F.sum(F.col("p") * F.ln(F.col("p") + 1e-12)) / F.ln(F.greatest(F.max("_k"), F.lit(2)))).alias("entropy"))
    return agg.withColumn("varied", (F.col("dominance") < DOMINANCE) & (F.col("entropy") > ENTROPY))


def ljung_box(panel: DataFrame, lags: tuple[int, ...] = (10, 20), value: str = "filled", most: int = 10_000) -> DataFrame:
    """item, channel, q<lag>: n (n + 2) times the sum of squared autocorrelations over n - k, of the last `most` steps."""
    newest = F.row_number().over(W.partitionBy(*SERIES).orderBy(F.desc("t")))
    p = panel.withColumn("_r", newest).where(F.col("_r") <= most)
    d = p.withColumn("_d", F.col(value) - F.avg(value).over(W.partitionBy(*SERIES)))
    top = max(lags)
    for k in range(1, top + 1):
        d = d.withColumn(f"_l{k}", F.lag("_d", k).over(along()))
    sums = d.groupBy(*SERIES).agg(F.count("*").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_s"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_p{k}") for k in range(1, top + 1)])
    rho = lambda k: F.try_divide(F.col(f"_p{k}"), F.nullif(F.col("_s"), F.lit(0.0)))
    q = lambda m: F.col("n") * (F.col("n") + 2) * sum((rho(k) * rho(k) / (F.col("n") - k) for k in range(2, m + 1)), rho(1) * rho(1) / (F.col("n") - 1))
    return sums.select(*SERIES, "n", *[q(m).alias(f"q{m}") for m in lags])


def chi2_tail(x: float, k: int) -> float:
    """P(chi-squared with an even number k of degrees of freedom > x)."""
    if k % 2:
        raise ValueError("an even number of degrees of freedom is needed")
    term = total = math.exp(-x / 2)
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return min(1.0, total)


def white_noise(panel: DataFrame, value: str = "filled") -> DataFrame:
    """item, channel, p_value (the smaller of lags 10 and 20), correlated; a series without variance passes."""

    @F.pandas_udf("double")
    def least(q10: pd.Series, q20: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else min(chi2_tail(a, 10), chi2_tail(b, 20)) for a, b in zip(q10, q20, strict=True)], dtype="float64")

    p = ljung_box(panel, value=value).withColumn("p_value", least("q10", "q20"))
    return p.select(*SERIES, "p_value", F.coalesce(F.col("p_value") <= P_VALUE, F.lit(True)).alias("correlated"))


def deviations(panel: DataFrame, width: int, value: str = "filled") -> DataFrame:
    """panel with deviation: |value - rolling median| over the rolling interquartile range (where that is 0 the series', or 1.35 standard deviations)."""
    w = W.partitionBy(*SERIES)
    rolled = rolling_median_iqr(panel, width, value)
    spread = F.percentile(value, F.lit(0.75)).over(w) - F.percentile(value, F.lit(0.25)).over(w)
    whole = F.when(spread == 0, F.stddev_samp(value).over(w) * 1.35).otherwise(spread)
    return rolled.withColumn("deviation", F.try_divide(F.abs(F.col(value) - F.col("median")), F.when(F.col("iqr") == 0, F.nullif(whole, F.lit(0.0))).otherwise(F.col("iqr"))))


def outlier_ratios(panel: DataFrame, width: int, value: str = "filled") -> DataFrame:
    """item, channel, transient_pct, extreme_pct, keep."""
    d = deviations(panel, width, value)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    x = F.col("deviation")
    agg = d.groupBy(*SERIES).agg(share((x > TRANSIENT) & (x < EXTREME)).alias("_t"), share(x >= EXTREME).alias("_e"))
    return agg.select(*SERIES, F.bround(F.col("_t") * 100, 2).alias("transient_pct"), F.bround(F.col("_e") * 100, 2).alias("extreme_pct"), (F.col("_e") <= EXTREME_SHARE).alias("keep"))


def clean_outliers(panel: DataFrame, width: int) -> DataFrame:
    """panel (filled, y) with cleaned: extreme values replaced by the value before (else after); what was missing stays so."""
    d = deviations(panel, width).withColumn("_v", F.when(F.coalesce(F.col("deviation") < EXTREME, F.lit(True)), F.col("filled")))
    f = forward_fill(d, "_v", "_f")
    return f.withColumn("cleaned", F.when(F.col("y").isNotNull(), F.col("_f"))).drop("_v", "_f", "median", "iqr", "deviation")


def screen(panel: DataFrame, least_length: int, width: int) -> DataFrame:
    """item, channel, predictable, checks: the reasons why a series is left out, in the order of the checks; later checks are made only where earlier ones passed."""
    filled = forward_fill(panel)
    joined = basic_checks(panel, least_length)
    for other in (constancy(filled), white_noise(filled), outlier_ratios(filled, width)):
        joined = joined.join(other, SERIES)
    early = F.filter(F.array(F.when(~F.col("length_ok"), "length"), F.when(~F.col("monotonic"), "timestamp"), F.when(~F.col("missing_ok"), "missing")), lambda x: x.isNotNull())
    late = F.when(~F.col("varied"), "constant").when(~F.col("correlated"), "white_noise").when(~F.col("keep"), "outliers")
    checks = F.when(F.size(early) > 0, early).when(late.isNotNull(), F.array(late)).otherwise(F.array().cast("array<string>"))
    return joined.select(*SERIES, checks.alias("checks")).withColumn("predictable", F.size("checks") == 0)


#: Series of a block; a task holds two blocks and a few numbers for each pair of theirs.
BLOCK = 1024


def _aligned(t: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values less their series' mean and where there are any, in a row for each series and a column for each step."""
    steps, at = np.unique(np.concatenate(t), return_inverse=True)
    row = np.repeat(np.arange(len(t)), [len(x) for x in t])
    values, has = np.zeros((len(t), len(steps))), np.zeros((len(t), len(steps)))
    values[row, at], has[row, at] = np.concatenate([x - x.mean() for x in y]), 1.0
    return values, has


def _correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """Pearson's of two series by deviations; None without variation."""
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        return np.nan
    if x.min() == x.max() or y.min() == y.max():
        return None
    x, y = x - x.mean(), y - y.mean()
    size = np.sqrt((x * x).mean()) * np.sqrt((y * y).mean())
    return (x * y).mean() / size if size else None


def _block_correlations(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in a and b (ranks of names, steps, values) of the pairs above threshold, and their correlations; those near it, or with hardly any variation, are worked out one by one."""
    odd = [~np.array([np.isfinite(y).all() for y in s[2]]) for s in (a, b)]
    with np.errstate(all="ignore"):
        x, has = _aligned([*a[1], *b[1]], [np.where(np.isfinite(y), y, 0.0) for y in (*a[2], *b[2])])
        (xa, xb), (ha, hb) = (np.split(z, [len(a[1])]) for z in (x, has))
        n = ha @ hb.T
        ma, mb, va, vb = xa @ hb.T / n, ha @ xb.T / n, (xa * xa) @ hb.T / n, ha @ (xb * xb).T / n
        da, db = va - ma * ma, vb - mb * mb
        found = (xa @ xb.T / n - ma * mb) / (np.sqrt(da) * np.sqrt(db))
        faint = (da <= 1e-8 * va) | (db <= 1e-8 * vb) | ~(np.abs(np.abs(found) - threshold) > 1e-9)
    again = (n > 0) & (odd[0][:, None] | odd[1][None, :] | (n > 1) & faint)
    once = a[0][:, None] < b[0][None, :] if a is b else a[0][:, None] != b[0][None, :]
    still = [np.array([y.min() == y.max() for y in s[2]]) for s in (a, b)]
    again &= once & (~(still[0][:, None] | still[1][None, :]) | odd[0][:, None] | odd[1][None, :])
    found = np.where((n > 1) & ~faint & ~odd[0][:, None] & ~odd[1][None, :], found, 0.0)
    keep = once & (np.abs(found) > threshold)
    for i, j in zip(*np.nonzero(again), strict=True):
        both = (ha[i] > 0) & (hb[j] > 0)
        y = [s[2][k][both[h > 0]] for s, k, h in ((a, i, ha[i]), (b, j, hb[j]))]
        r = _correlation(*y)
        keep[i, j] = r is not None and not abs(r) <= threshold
        found[i, j] = 0.0 if r is None else r
    i, j = np.nonzero(keep)
    return i, j, found[i, j]


def correlated_pairs(panel: DataFrame, within_item: bool = True, threshold: float = CORRELATED) -> DataFrame:
    """Pairs of variates (a < b) and their correlation over steps where both are observed, above threshold.

    Within items, or between all series of the same length.  Each group's series are dealt into blocks of about
    BLOCK; a task takes the sums of all pairs of two blocks by matrix products, and only pairs above threshold leave it.
    """
    key = F.concat_ws("/", "item", F.col("channel").cast("string"))
    every = panel.groupBy(*["item"] * within_item, key.alias("name"))
    group = (F.col("item") if within_item else F.col("_n")).cast("string").alias("g")
    seen = F.array_sort(F.collect_list(F.when(F.col("y").isNotNull(), F.struct("t", F.col("y").cast("double").alias("y")))))
    rows = every.agg(F.count("*").alias("_n"), seen.alias("v")).where(F.size("v") > 0).select(group, "name", F.col("v.t").cast("array<long>").alias("t"), F.col("v.y").alias("y"))
    sizes = every.agg(F.count("*").alias("_n")).groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    placed = rows.join(sizes if within_item else F.broadcast(sizes), "g").withColumn("p", F.pmod(F.xxhash64("name"), F.col("parts")))  # by length: a row for each
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("o")
    dealt = placed.select("g", "name", "t", "y", "p", other).select("g", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "p", "name", "t", "y")

    def pairs(table: pa.Table) -> pa.Table:
        parts, names = table.column("p").to_numpy(), table.column("name").to_pylist()
        rank = np.unique(np.array(names), return_inverse=True)[1]
        arrays = [[x.values.to_numpy(zero_copy_only=False) for x in table.column(c)] for c in ("t", "y")]
        sides = [np.flatnonzero(parts == p) for p in np.unique(parts)]
        blocks = [(rank[s], [arrays[0][k] for k in s], [arrays[1][k] for k in s]) for s in sides]
        if len(blocks) == 1 and table.column("i")[0] != table.column("j")[0]:
            return pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "r": pa.array([], pa.float64())})
        i, j, r = _block_correlations(blocks[0], blocks[-1], threshold)
        i, j = sides[0][i], sides[-1][j]
        swap = rank[i] > rank[j]
        names = pa.array(names, pa.string())
        return pa.table({"a": names.take(pa.array(np.where(swap, j, i))), "b": names.take(pa.array(np.where(swap, i, j))), "r": pa.array(r, pa.float64())})

    return dealt.groupBy("g", "i", "j").applyInArrow(pairs, "a string, b string, r double")


def dataset_summary(screened: DataFrame, panel: DataFrame) -> DataFrame:
    """channel, kept, total, ratio, recommended (drop under a half), observations, series without a kept variate."""
    n = panel.groupBy(*SERIES).agg(F.count("y").alias("observations"))
    per = screened.join(n, SERIES).groupBy("channel").agg(F.sum(F.col("predictable").cast("int")).alias("kept"), F.count("*").alias("total"), F.sum("observations").alias("observations"))
    return per.withColumn("ratio", F.col("kept") / F.col("total")).withColumn("recommended", F.when(F.col("ratio") >= 0.5, "keep").otherwise("drop"))


def dropped(screened: DataFrame) -> DataFrame:
    """item, variates and reasons (each once, in order) of the items without a kept variate; screened has predictable and checks."""
    per = screened.groupBy("item").agg(F.count("*").alias("variates"), F.count_if("predictable").alias("kept"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("checks")))).alias("reasons"))
    return per.where("kept = 0").drop("kept")


def drop_recommended(panel: DataFrame, screened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(panel without the channels that dataset_summary recommends to drop and without the variates screened out, its summary)."""
    poor = dataset_summary(screened, panel).where("recommended = 'drop'").select("channel")
    kept = screened.where("predictable").join(F.broadcast(poor), "channel", "left_anti")  # a row for each channel
    left = panel.join(kept.select(*SERIES), SERIES, "left_semi")
    return left, dataset_summary(kept, left)


def drop_variates(panel: DataFrame, channels: list[int] | None = None, items: list[str] | None = None) -> DataFrame:
    kept = panel if channels is None else panel.where(~F.col("channel").isin(channels))
    return kept if items is None else kept.where(~F.col("item").isin(items))
