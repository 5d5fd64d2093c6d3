"""What adaptors learn from: each reference's forecasts, its neighbours' futures and forecasts, and why a row cannot be adapted.

References have ref_id, item, channel, split, tick, scale, context, target and rep (arrays, null where missing).
The result is one row for each query reference, in arrays, so that a window is never split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from . import forecast, retrieval

NESTED = "array<array<double>>"


def whole(a: Column) -> Column:
    """Whether an array is there and has no missing value."""
    return F.coalesce(F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def past_forecast(rows: DataFrame) -> DataFrame:
    """ref_id and past: the mean forecast of an item's other channels at the same tick, each brought to the level and scale of the reference's own context; none where there is no other channel."""
    other = rows.select("item", F.col("channel").alias("_channel"), "tick", F.col("context").alias("_context"), F.col("vanilla").alias("_vanilla"))
    pairs = rows.select("ref_id", "item", "channel", "tick", "context").join(other, ["item", "tick"]).where("channel <> _channel")
    each = pairs.select("ref_id", F.posexplode(vectors.rescaled(F.col("_vanilla"), F.col("_context"), F.col("context"))).alias("h", "y"))
    mean = each.groupBy("ref_id", "h").agg(F.avg("y").alias("y"))
    return mean.groupBy("ref_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "y"))), lambda z: z["y"]).alias("past"))


def extract(asked: DataFrame, store: DataFrame, plain: Callable[[], forecast.Forecaster], retrieving: Callable[[], forecast.Forecaster], horizon: int, stride: int, ks: tuple[int, ...], scope: str = "all") -> DataFrame:
    """asked, without context and rep, with vanilla, past, neighbour_ids, neighbours (targets) and own (forecasts made there) by rank, context_<k> for each k, and reason (codes of forecast.REASONS for the largest k).

    plain forecasts each window by itself, retrieving from it and its first k neighbours' futures.
    """
    most = max(ks)
    made = forecast.forecast(store.select("ref_id", "context"), plain, horizon, ["ref_id"]).withColumnRenamed("yhat", "own")
    futures = store.select("ref_id", "target").join(made, "ref_id")
    near = retrieval.nearest_blocks(asked, store, stride, horizon, most, scope).select("query_id", "rank", "ref_id").join(futures, "ref_id")
    lists = near.groupBy(F.col("query_id").alias("ref_id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("ref_id").alias("id"), "target", "own"))).alias("n"))
    part = lambda field: F.transform("n", lambda z: z[field])
    lists = lists.select("ref_id", part("id").alias("neighbour_ids"), part("target").alias("neighbours"), part("own").alias("own"))
    vanilla = forecast.forecast(asked.select("ref_id", "context"), plain, horizon, ["ref_id"]).withColumnRenamed("yhat", "vanilla")
    rows = asked.join(vanilla, "ref_id")
    rows = rows.join(past_forecast(rows), "ref_id", "left").join(lists, "ref_id", "left")
    none = F.array().cast(NESTED)
    rows = rows.withColumns({"neighbour_ids": F.coalesce("neighbour_ids", F.array().cast("array<string>")), "neighbours": F.coalesce("neighbours", none), "own": F.coalesce("own", none)})
    for k in ks:
        usable = rows.where(F.size("neighbours") >= k).select("ref_id", "context", F.slice("neighbours", 1, k).alias("_near"))
        found = forecast.forecast(usable.where(F.forall("_near", whole)), retrieving, horizon, ["ref_id"], "_near").withColumnRenamed("yhat", f"context_{k}")
        rows = rows.join(found, "ref_id", "left")
    near = F.forall("neighbours", whole) & F.forall("own", whole)  # without which there is no forecast from them to judge
    checks = rows.select("*", F.size("neighbours").alias("_n"), whole(F.col("target")).alias("target_finite"), whole(F.col("vanilla")).alias("vanilla_finite"), near.alias("neighbour_finite"), (~near | whole(F.col(f"context_{most}"))).alias("covariate_finite"))
    checked = forecast.eligibility(checks.withColumn("_all", F.col("neighbours")).withColumn("neighbours", F.col("_n")), most)
    return checked.withColumn("neighbours", F.col("_all")).drop("_all", "_n", "target_finite", "vanilla_finite", "covariate_finite", "neighbour_finite", "context", "rep")


def adapted(k: int) -> Column:
    """Whether a row can be fitted and adapted with k neighbours."""
    near = F.slice("neighbours", 1, k)
    return labelled() & (F.size("neighbours") >= k) & F.forall(near, whole) & F.forall(F.slice("own", 1, k), whole) & whole(F.col(f"context_{k}"))


def labelled() -> Column:
    return whole(F.col("target")) & whole(F.col("vanilla")) & F.col("scale").isNotNull()


def coverage(rows: DataFrame, keys: list[str], ks: tuple[int, ...]) -> DataFrame:
    """keys, k, windows and dates by what became of them: a fallback is labelled but not adapted, an excluded one not labelled."""
    flags = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), adapted(k).alias("adapted")) for k in ks]))
    each = rows.select(*keys, "tick", labelled().alias("labelled"), flags.alias("f")).select(*keys, "tick", "labelled", "f.*")
    return each.groupBy(*keys, "k").agg(
        F.count("*").alias("total_windows"),
        F.count_if("labelled").alias("label_complete_windows"),
        F.count_if("adapted").alias("adapted_windows"),
        F.count_if(F.col("labelled") & ~F.col("adapted")).alias("vanilla_fallback_windows"),
        F.count_if(~F.col("labelled")).alias("excluded_label_windows"),
        F.countDistinct("tick").alias("total_dates"),
        F.countDistinct(F.when(F.col("adapted"), F.col("tick"))).alias("adapted_dates"),
    )
