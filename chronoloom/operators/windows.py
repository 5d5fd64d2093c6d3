"""Split algebra: intervals, origins, references, caps and windows of series.

Frames of series have a row each: item, length (and start_tick).  Half-open intervals; origins are the
first forecast step; a channel of -1 stands for all channels of an item at once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def span(windows: int, horizon: int, stride: int) -> int:
    return horizon + (windows - 1) * stride


@dataclass(frozen=True)
class Preparation:
    """What a four-way causal split is made by."""

    test_length: int
    horizon: int
    context: int
    period: int
    fitting_stride: int
    datastore_stride: int
    cap: int | None = None
    cross_variate: bool = False
    least_dates: int = 1

    def __post_init__(self) -> None:
        for name in ("test_length", "horizon", "context", "period", "fitting_stride", "datastore_stride"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.test_length < self.horizon:
            raise ValueError("test_length must hold a whole horizon")
        if self.datastore_stride % self.period:
            raise ValueError("datastore_stride must be a multiple of the period")
        if self.period > 1 and gcd(self.fitting_stride, self.period) != 1:
            raise ValueError("fitting_stride and the period must have no common divisor")

    @property
    def windows(self) -> int:
        return self.test_length // self.horizon


def steps(first: Column, last: Column, step: Column | int) -> Column:
    """An array first, first + step, ... up to last; empty if last is before first."""
    return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long") if isinstance(step, int) else step)).otherwise(F.array().cast("array<bigint>"))


def lengths(panel: DataFrame) -> DataFrame:
    """item, length: steps of each item, missing ones too."""
    return panel.groupBy("item").agg((F.max("t") + 1).alias("length"))


def length_summary(series: DataFrame) -> DataFrame:
    return series.agg(F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.avg("length").alias("avg_length"), F.sum("length").alias("sum_length"), F.count("*").alias("series"))


def holdout_windows(series: DataFrame, test_length: int, val_length: int, horizon: int) -> DataFrame:
    """item, split (val, test), window, origin: non-overlapping windows of the last parts."""
    val = F.col("length") - test_length - val_length
    parts = F.array(F.struct(F.lit("val").alias("split"), val.alias("first"), F.lit(val_length // horizon).alias("n")), F.struct(F.lit("test").alias("split"), (F.col("length") - test_length).alias("first"), F.lit(test_length // horizon).alias("n")))
    rows = series.select("item", F.explode(parts).alias("p")).where("p.n > 0")
    return rows.select("item", "p.split", F.posexplode(steps(F.col("p.first"), F.col("p.first") + (F.col("p.n") - 1) * horizon, horizon)).alias("window", "origin"))


def check_lengths(series: DataFrame, test_length: int, val_length: int, horizon: int) -> list[str]:
    """Raises where the parts do not fit the shortest series; warnings otherwise."""
    least = series.agg(F.min("length")).first()[0]
    for name, n in (("test_length", test_length), ("val_length", val_length)):
        if n <= 0 or n < horizon:
            raise ValueError(f"{name} must be positive and hold a horizon")
    if least is None or test_length + val_length > least:
        raise ValueError("the shortest series does not hold both parts")
    return [f"{name} is over half of the shortest series" for name, n in (("test_length", test_length), ("val_length", val_length)) if n > least / 2]


def intervals(series: DataFrame, p: Preparation) -> DataFrame:
    """item, split, start, stop: datastore, train (2n windows), validation (n windows), test."""
    n = p.windows
    test = F.col("length") - p.test_length
    val = F.greatest(F.lit(0), test - span(n, p.horizon, p.fitting_stride))
    train = F.greatest(F.lit(0), val - span(2 * n, p.horizon, p.fitting_stride))
    rows = F.array(*[F.struct(F.lit(s).alias("split"), a.cast("long").alias("start"), b.cast("long").alias("stop")) for s, a, b in (("datastore", F.lit(0), train), ("train", train, val), ("validation", val, test), ("test", test, F.col("length")))])
    return series.where(F.col("length") >= p.test_length).select("item", F.explode(rows).alias("i")).select("item", "i.*")


def query_origins(parts: DataFrame, p: Preparation) -> DataFrame:
    """item, split, origin: strided origins of train and validation with a whole context, and official ones of test."""
    start, k = F.col("start"), p.fitting_stride
    first = start + F.greatest(F.lit(0), F.ceil((p.context - start) / k)) * k
    strided = parts.where(F.col("split").isin("train", "validation")).select("item", "split", F.explode(steps(first, F.col("stop") - p.horizon, k)).alias("origin"))
    official = parts.where("split = 'test'").select("item", "split", F.explode(steps(start, F.col("stop") - p.horizon, p.horizon)).alias("origin"))
    return strided.unionByName(official)


def residues(queries: DataFrame, period: int, tick: str = "tick") -> DataFrame:
    return queries.select(F.pmod(tick, F.lit(period)).alias("residue")).distinct()


def phase_origins(parts: DataFrame, phases: DataFrame, p: Preparation) -> DataFrame:
    """item, origin: datastore origins congruent to a phase (item, phase) by the datastore stride."""
    k = p.datastore_stride
    first = F.greatest(F.col("start"), F.lit(p.context))
    store = parts.where("split = 'datastore'").join(phases, "item")
    aligned = first + F.pmod(F.col("phase") - first, F.lit(k))
    return store.select("item", F.explode(steps(aligned, F.col("stop") - p.horizon, k)).alias("origin")).distinct()


def references(origins: DataFrame, channels: DataFrame | None) -> DataFrame:
    """Origins of every channel (item, channel), or of channel -1 for whole items."""
    return origins.withColumn("channel", F.lit(-1)) if channels is None else origins.join(channels, "item")


def recent_cap(refs: DataFrame, most: int, cross_variate: bool, tick: str = "tick", needed: bool = True) -> DataFrame:
    """The latest windows of each series: most of them, or an equal share of most across series; a share of none is an error where windows are needed, else no rows."""
    series = ["item", "channel"]
    newest = F.row_number().over(W.partitionBy(*series).orderBy(F.desc(tick), F.desc("origin")))
    if not cross_variate:
        return refs.withColumn("_r", newest).where(F.col("_r") <= most).drop("_r")
    total = refs.groupBy(*series).count().agg(F.sum("count").alias("rows"), F.count("*").alias("series"))
    share = F.when(F.col("rows") <= most, F.col("rows")).otherwise(F.floor(F.lit(most) / F.col("series")))
    if needed:
        share = F.when(share <= 0, F.raise_error(F.lit("the cap leaves no window for some series"))).otherwise(share)
    one = total.select(share.alias("_k"))
    return refs.withColumn("_r", newest).join(F.broadcast(one), F.col("_r") <= F.col("_k")).drop("_r", "_k")


def least_dates(refs: DataFrame) -> DataFrame:
    return refs.groupBy("item", "channel").count().agg(F.min("count").alias("least_dates"))


def require_dates(refs: DataFrame, least: int) -> None:
    have = least_dates(refs).first()[0] or 0
    if have < least:
        raise ValueError(f"at least {least} dates for each series are needed; the least covered has {have}")


def rolling_origins(queries: DataFrame, series: DataFrame, p: Preparation, count: int, stride: int | None = None) -> DataFrame:
    """query_id, item, origin: the newest count origins of each item that end before a query (query_id, item, tick), the newest congruent to it by the period, each a stride (by default the datastore's) from the next."""
    stride = stride or p.datastore_stride
    last = F.least(F.col("tick") - p.horizon, F.col("start_tick") + F.col("length") - p.horizon)
    last = last - F.pmod(last - F.col("tick"), F.lit(p.period)) - F.col("start_tick")
    rows = queries.join(series, "item").withColumn("_last", last).where(F.col("_last") >= p.context)
    n = F.least(F.lit(count) - 1, F.floor((F.col("_last") - p.context) / stride))
    back = F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.col("_last") - i * stride)
    return rows.select("query_id", "item", F.explode(back).alias("origin"))


def materialise(refs: DataFrame, arrays: DataFrame, context: int, horizon: int) -> DataFrame:
    """refs with context and target arrays, from arrays (item, channel, values); a window past either end is an error."""
    rows = refs.join(arrays, ["item", "channel"])
    fits = (F.col("origin") >= context) & (F.col("origin") + horizon <= F.size("values"))
    whole = F.when(fits, F.col("values")).otherwise(F.raise_error(F.lit("a window runs past its series")))
    return rows.withColumn("context", F.slice(whole, (F.col("origin") - context + 1).cast("int"), context)).withColumn("target", F.slice(whole, (F.col("origin") + 1).cast("int"), horizon)).drop("values")


def other_variates(refs: DataFrame, arrays: DataFrame, context: int) -> DataFrame:
    """The other channels' history of each reference: item, channel, origin, other, past."""
    others = arrays.select("item", F.col("channel").alias("other"), "values")
    rows = refs.join(others, "item").where("other <> channel")
    return rows.select("item", "channel", "origin", "other", F.slice("values", (F.col("origin") - context + 1).cast("int"), context).alias("past"))


def covariate_window(values: Column, origin: Column, context: int, horizon: int) -> Column:
    """Context and horizon values of a covariate, non-finite ones null, nulls after its end."""
    part = F.slice(values, (origin - context + 1).cast("int"), context + horizon)
    clean = F.transform(part, lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))
    return F.concat(clean, F.array_repeat(F.lit(None).cast("double"), F.lit(context + horizon) - F.size(part)))


def prepare(series: DataFrame, channels: DataFrame | None, p: Preparation) -> DataFrame:
    """All references of a preparation: item, channel, split, origin, tick; series has item, length, start_tick."""
    parts = intervals(series, p)
    ticks = series.select("item", "start_tick")
    ask = query_origins(parts, p).join(ticks, "item").withColumn("tick", F.col("origin") + F.col("start_tick"))
    phases = ticks.crossJoin(F.broadcast(residues(ask, p.period))).select("item", F.explode(steps(F.lit(0), F.lit(p.datastore_stride - p.period), p.period)).alias("k"), "residue", "start_tick").select("item", (F.col("residue") + F.col("k") - F.col("start_tick")).alias("phase"))
    store = phase_origins(parts, phases, p).join(ticks, "item").select("item", F.lit("datastore").alias("split"), "origin", (F.col("origin") + F.col("start_tick")).alias("tick"))
    store, ask = references(store, channels), references(ask.drop("start_tick"), channels)
    if p.cap:
        store = recent_cap(store, p.cap, p.cross_variate)
    return store.unionByName(ask)


def preparation_report(series: DataFrame, channels: DataFrame | None, p: Preparation) -> DataFrame:
    """split, refs, dates, cap_removed (references that the cap took away), series and excluded_series (too short for a test part)."""
    made = prepare(series, channels, p).groupBy("split").agg(F.count("*").alias("refs"), F.countDistinct("tick").alias("dates"))
    before = prepare(series, channels, replace(p, cap=None)).groupBy("split").agg(F.count("*").alias("_all")) if p.cap else made.select("split", F.col("refs").alias("_all"))
    short = series.agg(F.count("*").alias("series"), F.count_if(F.col("length") < p.test_length).alias("excluded_series"))
    rows = before.join(made, "split", "left").crossJoin(F.broadcast(short))  # one row
    refs = F.coalesce("refs", F.lit(0))
    return rows.select("split", refs.alias("refs"), F.coalesce("dates", F.lit(0)).alias("dates"), (F.col("_all") - refs).alias("cap_removed"), "series", "excluded_series")


def profiles(spec: dict[str, int | None]) -> dict[int | None, list[str]]:
    """Context limits and the models that share each."""
    found: dict[int | None, list[str]] = {}
    for name, limit in spec.items():
        found.setdefault(limit, []).append(name)
    return found
