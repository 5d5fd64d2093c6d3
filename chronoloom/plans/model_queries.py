"""Queries of retrieval, vector kernels, ridge adaptors and forecasters over the hourly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import evaluation, extraction, family, forecast, metrics, retrieval, ridge, series, windows
from ..operators.series import SERIES
from ..sources.stages import stored
from .registry import query, r
from .series_queries import HOURS, ORIGINS, PANEL, PREP, STORE, TEST, H, L, M, hourly_panel, lengths, naive_cells, prepared

K = 3
#: Numbers of neighbours that extraction makes forecasts from.
KS = (1, 3)
#: Hours over which extraction carries a value on.
PATCH = 12
_REF = "item || '/' || channel || '/' || origin"
_CHANNELS = "(SELECT unnest([0, 1]) AS channel)"
_REFS = f"(SELECT item, channel, origin, split FROM {ORIGINS}, {_CHANNELS} WHERE split = 'test' UNION ALL SELECT item, channel, origin, 'datastore' FROM {STORE}, {_CHANNELS})"
#: Representations of test queries and datastore references, one row for each step.
REPS = (
    PANEL
    + f", refs AS (SELECT {_REF} AS ref_id, * FROM {_REFS}), raw AS (SELECT r.ref_id, r.split, r.item, r.channel, r.origin, p.t - r.origin + {L} AS i, p.y FROM refs r JOIN panel p ON p.item = r.item AND p.channel = r.channel AND p.t >= r.origin - {L} AND p.t < r.origin), rep AS (SELECT *, (y - avg(y) OVER w) / greatest(stddev_pop(y) OVER w, 1e-8) AS x FROM raw WINDOW w AS (PARTITION BY ref_id))"
)
PAIRS = (
    ", q AS (SELECT * FROM rep WHERE split = 'test'), s AS (SELECT * FROM rep WHERE split = 'datastore'), dist AS (SELECT q.ref_id AS query_id, s.ref_id, q.item || '/' || q.channel AS q_item, s.item || '/' || s.channel AS s_item, count(CASE WHEN q.x IS NOT NULL AND s.x IS NOT NULL THEN 1 END) AS overlap, sqrt(sum((q.x - s.x) * (q.x - s.x)) * "
    + f"{L} / nullif(count(CASE WHEN q.x IS NOT NULL AND s.x IS NOT NULL THEN 1 END), 0)) AS euclid, 1 - greatest(-1, least(1, sum(q.x * s.x) / nullif(sqrt(sum(CASE WHEN s.x IS NOT NULL THEN q.x * q.x END)) * sqrt(sum(CASE WHEN q.x IS NOT NULL THEN s.x * s.x END)), 0))) AS cosine FROM q JOIN s ON q.i = s.i AND (q.origin - s.origin) % 24 = 0 AND s.origin + {H} <= q.origin GROUP BY 1, 2, 3, 4), near AS (SELECT query_id, ref_id, q_item, s_item, euclid, CAST(row_number() OVER (PARTITION BY query_id ORDER BY euclid, ref_id) AS INTEGER) AS rank FROM dist WHERE overlap >= ceil({L} * 0.8))"
)


def made_references(refs: DataFrame, panel: DataFrame) -> DataFrame:
    made = windows.materialise(refs, series.arrays(panel), L, H)
    return made.withColumn("ref_id", F.concat_ws("/", "item", F.col("channel").cast("string"), F.col("origin").cast("string"))).withColumn("rep", vectors.normalised(F.col("context")))


def all_references(spark, sf_dir) -> DataFrame:
    """References of all splits and channels, with ref_id, context, target and rep; worked out once."""
    return stored(spark, f"{sf_dir}/events.parquet", "references", lambda: made_references(prepared(spark, sf_dir), hourly_panel(spark, sf_dir)))


def references(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Test queries and datastore references."""
    made = all_references(spark, sf_dir)
    return made.where("split = 'test'"), made.where("split = 'datastore'")


def extracted(spark, sf_dir) -> DataFrame:
    """Every reference of training, validation and test with its forecasts and neighbours, as one task, hours without a value taking the last one of the PATCH hours before; worked out once."""

    def build() -> DataFrame:
        newest = W.partitionBy(*SERIES).orderBy("t").rowsBetween(-PATCH, 0)
        patched = hourly_panel(spark, sf_dir).withColumn("y", F.last("y", True).over(newest))
        every = stored(spark, f"{sf_dir}/events.parquet", "patched", lambda: made_references(prepared(spark, sf_dir), patched))
        store = every.where("split = 'datastore'")
        scales = series.prefix_scales(hourly_panel(spark, sf_dir), M).select(*SERIES, "origin", F.col("msse_scale").alias("scale"))
        asked = every.where("split <> 'datastore'").join(scales, [*SERIES, "origin"], "left")
        made = extraction.extract(asked, store, lambda: forecast.SeasonalNaive(M), lambda: forecast.RetrievalMean(M), H, PREP.datastore_stride, KS)
        return made.withColumn("task", F.lit("events/H"))

    return stored(spark, f"{sf_dir}/events.parquet", "extracted", build)


def neighbours(spark, sf_dir, k: int = K) -> DataFrame:
    asked, store = references(spark, sf_dir)
    return retrieval.nearest_blocks(asked, store, PREP.datastore_stride, H, k)


@query(REPS + " SELECT ref_id, CAST(i AS INTEGER) AS i, " + r("x") + " AS x FROM rep WHERE split = 'test'")
def e2_representations(spark, sf_dir):
    return references(spark, sf_dir)[0].select("ref_id", F.posexplode("rep").alias("i", "x"))


@query(REPS + PAIRS + " SELECT query_id, ref_id, " + r("CASE WHEN overlap >= ceil(" + str(L) + " * 0.8) THEN euclid END") + " AS euclid, " + r("CASE WHEN overlap >= ceil(" + str(L) + " * 0.8) THEN cosine END") + " AS cosine FROM dist")
def e1_masked_distances(spark, sf_dir):
    asked, store = references(spark, sf_dir)
    return retrieval.pair_distances(asked, store, PREP.datastore_stride, H, ("euclidean", "cosine")).withColumnRenamed("euclidean", "euclid")


@query(REPS + PAIRS + " SELECT query_id, count(*) AS eligible, count(CASE WHEN q_item = s_item THEN 1 END) AS same_series, count(CASE WHEN q_item <> s_item THEN 1 END) AS other_series FROM dist GROUP BY 1")
def j6_chronological_join(spark, sf_dir):
    return retrieval.scope_counts(*references(spark, sf_dir), PREP.datastore_stride, H)


@query(
    PANEL
    + f"SELECT q.item || '/' || q.channel || '/' || q.origin AS query_id, count(*) AS eligible FROM (SELECT * FROM {ORIGINS}, {_CHANNELS} WHERE split = 'test') q, (SELECT * FROM {STORE}, {_CHANNELS}) s WHERE least(q.origin - {H}, 300) - (least(q.origin - {H}, 300) - q.origin % 24 + 240) % 24 >= s.origin AND (least(q.origin - {H}, 300) - (least(q.origin - {H}, 300) - q.origin % 24 + 240) % 24 - s.origin) % 24 = 0 GROUP BY 1"
)
def j6_fixed_end_join(spark, sf_dir):
    asked, store = references(spark, sf_dir)
    ends = store.groupBy("item").agg((F.max(F.col("tick") - F.col("origin")) + 300).alias("end_tick"))
    return retrieval.eligible(asked, store, 24, H, "all", ends, 24).groupBy("query_id").agg(F.count("*").alias("eligible"))


@query(REPS + PAIRS + f" SELECT query_id, rank, ref_id, " + r("euclid") + f" AS distance FROM near WHERE rank <= {K}")
def j7_nearest_neighbours(spark, sf_dir):
    return neighbours(spark, sf_dir)


@query(REPS + PAIRS + f" SELECT query_id, count(*) AS eligible, count(CASE WHEN overlap >= ceil({L} * 0.8) THEN 1 END) AS comparable FROM dist GROUP BY 1")
def j7_neighbour_coverage(spark, sf_dir):
    return retrieval.coverage(*references(spark, sf_dir), PREP.datastore_stride, H)


_FILLED = PANEL + f", refs AS (SELECT {_REF} AS ref_id, * FROM {_REFS}), rep AS (SELECT r.ref_id, r.split, r.item, r.channel, r.origin, p.t - r.origin AS i, p.filled AS x FROM refs r JOIN filled p ON p.item = r.item AND p.channel = r.channel AND p.t >= r.origin - {L} AND p.t < r.origin)"


@query(_FILLED + f", dist AS (SELECT q.ref_id AS query_id, s.ref_id, sum((q.x - s.x) * (q.x - s.x)) AS d FROM rep q JOIN rep s ON q.item = s.item AND q.channel = s.channel AND q.i = s.i WHERE q.split = 'test' AND s.split = 'datastore' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rn, count(*) OVER (PARTITION BY query_id) AS n FROM dist) SELECT query_id, ref_id, " + r("d") + f" AS distance, CAST(rn AS INTEGER) AS rank FROM k WHERE n > {K} AND rn <= {K}")
def j8_flat_search(spark, sf_dir):
    refs = prepared(spark, sf_dir).where("split in ('test', 'datastore')")
    filled = series.arrays(series.forward_fill(hourly_panel(spark, sf_dir)), "filled")
    made = windows.materialise(refs, filled, L, H).select("item", "channel", "split", F.concat_ws("/", "item", F.col("channel").cast("string"), F.col("origin").cast("string")).alias("ref_id"), F.col("context").alias("rep"))
    return retrieval.flat_search(made.where("split = 'test'"), made.where("split = 'datastore'"), K)


@query(REPS + PAIRS + f", fut AS (SELECT r.ref_id, avg(p.y) AS m FROM refs r JOIN panel p ON p.item = r.item AND p.channel = r.channel AND p.t >= r.origin AND p.t < r.origin + {H} GROUP BY 1) SELECT query_id, CAST(count(*) AS BIGINT) AS neighbours, " + r("avg(m)") + f" AS mean_future FROM near JOIN fut USING (ref_id) WHERE rank <= {K} GROUP BY 1")
def j11_neighbour_futures(spark, sf_dir):
    _, store = references(spark, sf_dir)
    values = store.select("ref_id", vectors.mean(F.col("target")).alias("m"))
    g = retrieval.gather(neighbours(spark, sf_dir), values, "m", K)
    return g.select("query_id", F.size("neighbours").cast("long").alias("neighbours"), vectors.mean(F.col("neighbours")).alias("mean_future"))


@query(
    REPS + PAIRS + ", st AS (SELECT ref_id, avg(y) AS m, greatest(stddev_pop(y), 1e-8) AS s FROM raw GROUP BY 1), fut AS (SELECT r.ref_id, p.t - r.origin AS h, p.y FROM refs r JOIN panel p ON p.item = r.item AND p.channel = r.channel AND p.t >= r.origin AND p.t < r.origin + " + str(H) + ") SELECT query_id, CAST(h AS INTEGER) AS h, " + r("(y - a.m) / a.s * b.s + b.m") + " AS y FROM near JOIN fut USING (ref_id) JOIN st a ON a.ref_id = near.ref_id JOIN st b ON b.ref_id = query_id WHERE rank = 1"
)
def e3_rescaled_neighbours(spark, sf_dir):
    asked, store = references(spark, sf_dir)
    first = neighbours(spark, sf_dir, 1).select("query_id", "ref_id")
    near = first.join(store.select("ref_id", F.col("context").alias("n_context"), "target"), "ref_id").join(asked.select(F.col("ref_id").alias("query_id"), "context"), "query_id")
    return near.select("query_id", F.posexplode(vectors.rescaled(F.col("target"), F.col("n_context"), F.col("context"))).alias("h", "y"))


@query(REPS + " SELECT ref_id, " + r("greatest(stddev_pop(y), 1e-8)") + " AS query_scale FROM raw WHERE split = 'test' GROUP BY 1")
def e4_query_scale(spark, sf_dir):
    return references(spark, sf_dir)[0].select("ref_id", F.greatest(vectors.std_pop(F.col("context")), F.lit(1e-8)).alias("query_scale"))


@query(PANEL + f"SELECT w.item, p.channel, w.origin, CAST(t - w.origin + {L} + 8 AS INTEGER) AS i, " + r("p.y") + f" AS y FROM wins w JOIN panel p ON p.item = w.item AND p.t >= w.origin - {L} AND p.t < w.origin + {H} UNION ALL SELECT item, channel, origin, CAST(k AS INTEGER), NULL FROM wins, {_CHANNELS}, (SELECT unnest(range(8)) AS k)")
def e8_aligned_sequences(spark, sf_dir):
    asked = references(spark, sf_dir)[0]
    return asked.select("item", "channel", "origin", F.posexplode(vectors.aligned(F.col("context"), F.col("target"), L + 8, H)).alias("i", "y"))


# Ridge adaptors: V is the seasonal-naive forecast, C that of a week's season.

DESIGN = (
    PANEL
    + f", design AS (SELECT c.item, c.channel, c.win, c.h, c.scale, c.y - c.yhat AS residual, c.yhat AS v, w.filled AS cv, c.y, c.origin FROM cells c JOIN filled w ON w.item = c.item AND w.channel = c.channel AND w.t = c.origin - 168 + c.h WHERE c.y IS NOT NULL), k AS (SELECT item, channel, sum(v / s * v / s) AS x00, sum(v / s * cv / s) AS x01, sum(cv / s * cv / s) AS x11, sum(v / s * residual / s) AS y0, sum(cv / s * residual / s) AS y1, sum(residual / s * residual / s) AS yy, count(*) AS n, count(DISTINCT win) AS windows FROM (SELECT *, greatest(scale, 1e-8) AS s FROM design) GROUP BY 1, 2)"
)
SOLVED = (
    ", n AS (SELECT *, greatest(sqrt(x00 / n), 1e-12) AS r0, greatest(sqrt(x11 / n), 1e-12) AS r1 FROM k), a AS (SELECT *, x00 / (r0 * r0) / n + 0.01 AS a, x11 / (r1 * r1) / n + 0.01 AS d, x01 / (r0 * r1) / n AS b, y0 / r0 / n AS p, y1 / r1 / n AS q FROM n), beta AS (SELECT item, channel, n, x00, x01, x11, y0, y1, yy, (d * p - b * q) / (a * d - b * b) / r0 AS b0, (a * q - b * p) / (a * d - b * b) / r1 AS b1 FROM a)"
)


def design(spark, sf_dir, wins: DataFrame | None = None) -> DataFrame:
    cells = naive_cells(spark, sf_dir, wins)
    week = series.forward_fill(hourly_panel(spark, sf_dir)).select(*SERIES, (F.col("t") + 168).alias("at"), F.col("filled").alias("c"))
    rows = cells.withColumn("at", F.col("origin") + F.col("h")).join(week, [*SERIES, "at"]).where("y is not null")
    return rows.select(*SERIES, "window", "origin", "h", "y", "scale", F.col("yhat").alias("vanilla"), (F.col("y") - F.col("yhat")).alias("residual"), F.array("yhat", "c").alias("x"))


def stats(spark, sf_dir) -> DataFrame:
    return ridge.statistics(design(spark, sf_dir), SERIES, 2)


_G = [("x00", "xtx", 0), ("x01", "xtx", 1), ("x11", "xtx", 2), ("y0", "xty", 0), ("y1", "xty", 1)]


@query(DESIGN + " SELECT item, channel, win, h, " + r("residual") + " AS residual, " + r("v") + " AS v, " + r("cv") + " AS c FROM design")
def e5_ridge_design(spark, sf_dir):
    return design(spark, sf_dir).select(*SERIES, F.col("window").alias("win"), "h", "residual", F.get("x", F.lit(0)).alias("v"), F.get("x", F.lit(1)).alias("c"))


@query(DESIGN + " SELECT item, channel, " + ", ".join(r(n) + f" AS {n}" for n, _, _ in _G) + ", " + r("yy") + " AS yy, n AS rows_, windows FROM k")
def g6_ridge_statistics(spark, sf_dir):
    return stats(spark, sf_dir).select(*SERIES, *[F.get(c, F.lit(i)).alias(n) for n, c, i in _G], "yy", F.col("rows").alias("rows_"), "windows")


@query(DESIGN + " SELECT channel, " + ", ".join(r(f"sum({n})") + f" AS {n}" for n, _, _ in _G) + ", CAST(sum(n) AS BIGINT) AS rows_ FROM k GROUP BY 1")
def g6_merged_statistics(spark, sf_dir):
    return ridge.merge(stats(spark, sf_dir), ["channel"], 2).select("channel", *[F.get(c, F.lit(i)).alias(n) for n, c, i in _G], F.col("rows").alias("rows_"))


@query(DESIGN + SOLVED + " SELECT item, channel, " + r("b0") + " AS b0, " + r("b1") + " AS b1 FROM beta")
def g7_ridge_solve(spark, sf_dir):
    return ridge.solve(stats(spark, sf_dir), 2, 0.01).select(*SERIES, F.get("beta", F.lit(0)).alias("b0"), F.get("beta", F.lit(1)).alias("b1"))


@query(DESIGN + SOLVED + " SELECT item, channel, " + r("b0") + " AS b0, " + r("b1") + " AS b1 FROM beta")
def g7_ridge_pair(spark, sf_dir):
    b0, b1 = ridge.solve_pair(0.01)
    return stats(spark, sf_dir).select(*SERIES, b0.alias("b0"), b1.alias("b1"))


@query(DESIGN + SOLVED + " SELECT item, channel, " + r("greatest(0, (yy - 2 * (b0 * y0 + b1 * y1) + b0 * b0 * x00 + 2 * b0 * b1 * x01 + b1 * b1 * x11) / n)") + " AS mse FROM beta")
def g8_mse_from_statistics(spark, sf_dir):
    return ridge.solve(stats(spark, sf_dir), 2, 0.01).select(*SERIES, ridge.mean_squared_error(2).alias("mse"))


def predicted(spark, sf_dir) -> DataFrame:
    beta = ridge.solve(stats(spark, sf_dir), 2, 0.01).select(*SERIES, "beta")
    return design(spark, sf_dir).join(beta, SERIES).withColumn("yhat", ridge.predict(F.col("vanilla"), F.col("x"), F.col("beta"), F.pmod("h", F.lit(5)) != 0))


@query(DESIGN + SOLVED + " SELECT item, channel, win, h, " + r("CASE WHEN h % 5 <> 0 THEN v + b0 * v + b1 * cv ELSE v END") + " AS yhat FROM design JOIN beta USING (item, channel)")
def e6_ridge_prediction(spark, sf_dir):
    return predicted(spark, sf_dir).select(*SERIES, F.col("window").alias("win"), "h", "yhat")


@query(DESIGN + " SELECT item, channel, win, h, " + r("0.7 * v + 0.3 * cv") + " AS yhat FROM design")
def e7_convex_mixture(spark, sf_dir):
    d = design(spark, sf_dir)
    return d.select(*SERIES, F.col("window").alias("win"), "h", ridge.mixture(F.lit(0.3), F.col("vanilla"), F.get("x", F.lit(1))).alias("yhat"))


@query(DESIGN + ", l AS (SELECT item, channel, win, avg(pow((y - v) / greatest(scale, 1e-8), 2)) AS va, avg(pow((y - cv) / greatest(scale, 1e-8), 2)) AS ca FROM design GROUP BY 1, 2, 3) SELECT item, sum(CASE WHEN ca < va THEN 1.0 WHEN ca = va THEN 0.5 ELSE 0.0 END) + 0.0 AS wins, count(*) AS trials, " + r("(1 + sum(CASE WHEN ca < va THEN 1.0 WHEN ca = va THEN 0.5 ELSE 0.0 END)) / (2.0 + count(*))") + " AS p FROM l GROUP BY 1")
def g10_win_evidence(spark, sf_dir):
    s = F.greatest("scale", F.lit(1e-8))
    e = lambda f: F.avg(F.pow((F.col("y") - f) / s, 2))
    losses = design(spark, sf_dir).groupBy(*SERIES, "window").agg(e(F.col("vanilla")).alias("vanilla"), e(F.get("x", F.lit(1))).alias("candidate"))
    return ridge.win_evidence(losses, ["item"])


@query(DESIGN + ", m AS (SELECT origin, item, channel, avg(pow((y - v) / greatest(scale, 1e-8), 2)) AS a FROM design GROUP BY 1, 2, 3) SELECT 'vanilla' AS method, origin AS tick, " + r("avg(a)") + " AS loss FROM m GROUP BY 2")
def g12_date_losses(spark, sf_dir):
    cells = design(spark, sf_dir).select(*SERIES, F.lit("vanilla").alias("method"), F.col("origin").alias("tick"), "y", F.col("vanilla").alias("yhat"), "scale")
    return ridge.date_losses(cells, ["method"])


@query()
def g13_bootstrap_selection(spark, sf_dir):
    d = design(spark, sf_dir)
    kinds = F.explode(F.array(F.struct(F.lit("vanilla").alias("method"), F.col("vanilla").alias("f")), F.struct(F.lit("week").alias("method"), F.get("x", F.lit(1)).alias("f")), F.struct(F.lit("mixture").alias("method"), ((F.col("vanilla") + F.get("x", F.lit(1))) / 2).alias("f")))).alias("m")
    cells = d.select(*SERIES, "origin", "h", "y", "scale", kinds).select(*SERIES, (F.col("origin") + F.floor(F.col("h") / 4)).alias("tick"), "y", "scale", "m.method", F.col("m.f").alias("yhat"))
    losses = ridge.date_losses(cells, ["method"]).withColumns({"task": F.lit("events/H"), "k": F.lit(0), "alpha": F.lit(None).cast("double")})
    return ridge.choose(losses, ["task"], H, 23)


@query(DESIGN + SOLVED + ", p AS (SELECT item, channel, win, avg(abs(y - CASE WHEN h % 5 <> 0 THEN v + b0 * v + b1 * cv ELSE v END)) / max(scale) AS mase, count(CASE WHEN h % 5 = 0 THEN 1 END) AS fallback, count(*) AS n FROM design JOIN beta USING (item, channel) GROUP BY 1, 2, 3) SELECT item, " + r("avg(mase)") + " AS mase, CAST(sum(fallback) AS BIGINT) AS fallback, " + r("sum(fallback) / CAST(sum(n) AS DOUBLE)") + " AS fallback_rate FROM p GROUP BY 1")
def g15_family_prediction(spark, sf_dir):
    p = predicted(spark, sf_dir)
    m = metrics.window_metrics(p).select(*metrics.WINDOW, "mase")
    n = p.groupBy("item").agg(F.count_if(F.pmod("h", F.lit(5)) == 0).alias("fallback"), F.count("*").alias("n"))
    return m.groupBy("item").agg(F.avg("mase").alias("mase")).join(n, "item").select("item", "mase", "fallback", (F.col("fallback") / F.col("n")).alias("fallback_rate"))


#: Windows of a long fitting period: a date every LONG_STEP hours from the hour LONG_FIRST on, more than the newest 100 that a rolling ridge takes.
LONG_FIRST, LONG_STEP, LONG_DATES = 192, 5, 101
LONG = (
    f", lw AS (SELECT item, CAST(k AS INTEGER) AS win, {LONG_FIRST} + k * {LONG_STEP} AS origin, CAST(h AS INTEGER) AS h, {LONG_FIRST} + k * {LONG_STEP} + h AS t FROM (SELECT DISTINCT item FROM e) i, (SELECT unnest(range({LONG_DATES})) AS k) k, (SELECT unnest(range({H})) AS h) h), "
    f"z AS (SELECT item, channel, t, y, lag(filled, {M}) OVER w AS v, lag(filled, 168) OVER w AS cv FROM filled WINDOW w AS (PARTITION BY item, channel ORDER BY t)), "
    "long_ AS (SELECT lw.item, z.channel, lw.win, lw.origin, lw.h, s.mase_scale AS scale, z.y - z.v AS residual, z.v, z.cv FROM lw JOIN z ON z.item = lw.item AND z.t = lw.t JOIN scales s ON s.item = lw.item AND s.channel = z.channel AND s.origin = lw.origin WHERE z.y IS NOT NULL)"
)


def long_design(spark, sf_dir) -> DataFrame:
    """Design rows of the long fitting period, tick being the date; dealt once, by item, since it has a row for each hour of each window."""
    cells = metrics.strided_cells(hourly_panel(spark, sf_dir).repartition("item"), M, H, LONG_FIRST, LONG_STEP, LONG_DATES, 168)
    return cells.where("y is not null").select(*SERIES, "window", F.col("origin").alias("tick"), "h", "scale", (F.col("y") - F.col("yhat")).alias("residual"), F.array("yhat", "other").alias("x"))


@query(
    PANEL
    + LONG
    + ", f AS (SELECT item, channel || '/' || win AS win, h % 6 AS h, greatest(scale, 1e-8) AS s, v, cv, residual, dense_rank() OVER (PARTITION BY item ORDER BY origin DESC) AS r FROM long_), kk AS (SELECT item, h, sum(v / s * v / s) AS x00, sum(v / s * cv / s) AS x01, sum(cv / s * cv / s) AS x11, sum(v / s * residual / s) AS y0, sum(cv / s * residual / s) AS y1, count(DISTINCT win) AS n FROM f WHERE r <= 100 GROUP BY 1, 2), n AS (SELECT *, greatest(sqrt(x00 / n), 1e-12) AS r0, greatest(sqrt(x11 / n), 1e-12) AS r1 FROM kk), a AS (SELECT *, x00 / (r0 * r0) / n + 0.01 AS a, x11 / (r1 * r1) / n + 0.01 AS d, x01 / (r0 * r1) / n AS b, y0 / r0 / n AS p, y1 / r1 / n AS q FROM n) SELECT item AS query_id, CAST(h AS INTEGER) AS h, "
    + r("(d * p - b * q) / (a * d - b * b) / r0")
    + " AS b0, "
    + r("(a * q - b * p) / (a * d - b * b) / r1")
    + " AS b1, n AS windows FROM a WHERE n >= 64"
)
def g16_horizon_ridge(spark, sf_dir):
    d = long_design(spark, sf_dir).select(F.col("item").alias("query_id"), "tick", F.concat_ws("/", "channel", "window").alias("window"), F.pmod("h", F.lit(6)).alias("h"), "scale", "residual", "x")
    asked = lengths(spark, sf_dir).select(F.col("item").alias("query_id"))
    b = ridge.horizon_ridge(d, asked, 2, 0.01, least=64, most=100)
    return b.select("query_id", "h", F.get("beta", F.lit(0)).alias("b0"), F.get("beta", F.lit(1)).alias("b1"), "windows")


@query(
    REPS + PAIRS + f", nn AS (SELECT query_id, count(*) AS n FROM near WHERE rank <= {K} GROUP BY 1), tg AS (SELECT r.ref_id, bool_and(p.y IS NOT NULL) AS ok FROM refs r JOIN panel p ON p.item = r.item AND p.channel = r.channel AND p.t >= r.origin AND p.t < r.origin + {H} GROUP BY 1), fu AS (SELECT query_id, bool_and(ok) AS ok FROM near JOIN tg USING (ref_id) WHERE rank <= {K} GROUP BY 1) SELECT CAST(CASE WHEN coalesce(n, 0) < {K} THEN 1 WHEN NOT tg.ok THEN 2 WHEN NOT coalesce(fu.ok, false) THEN 5 ELSE 0 END AS INTEGER) AS reason, count(*) AS rows_ FROM tg JOIN (SELECT DISTINCT ref_id FROM raw WHERE split = 'test') USING (ref_id) LEFT JOIN nn ON nn.query_id = tg.ref_id LEFT JOIN fu ON fu.query_id = tg.ref_id GROUP BY 1"
)
def g35_eligibility_reasons(spark, sf_dir):
    asked, store = references(spark, sf_dir)
    whole = lambda c: F.forall(c, lambda x: x.isNotNull())
    near = neighbours(spark, sf_dir).join(store.select("ref_id", whole("target").alias("ok")), "ref_id")
    per = near.groupBy(F.col("query_id").alias("ref_id")).agg(F.count("*").alias("neighbours"), F.bool_and("ok").alias("neighbour_finite"))
    rows = asked.select("ref_id", whole("target").alias("target_finite")).join(per, "ref_id", "left").fillna({"neighbours": 0, "neighbour_finite": False})
    rows = rows.withColumns({"vanilla_finite": F.lit(True), "covariate_finite": F.lit(True), "scale": F.lit(1.0)})
    return forecast.eligibility(rows, K).groupBy("reason").agg(F.count("*").alias("rows_"))


# Forecasters


def contexts(spark, sf_dir) -> DataFrame:
    return references(spark, sf_dir)[0].select("item", "channel", "origin", "context")


@query(PANEL + f", f AS (SELECT *, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY item, channel, origin ORDER BY t ROWS UNBOUNDED PRECEDING), first_value(y IGNORE NULLS) OVER (PARTITION BY item, channel, origin ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS x FROM (SELECT w.item, p.channel, w.origin, p.t, p.y FROM wins w JOIN panel p ON p.item = w.item AND p.t >= w.origin - {L} AND p.t < w.origin)) SELECT item, channel, origin, CAST(t - origin + {M} AS INTEGER) AS h, " + r("x") + f" AS yhat FROM f WHERE t >= origin - {M}")
def u1_seasonal_naive_forecaster(spark, sf_dir):
    made = forecast.forecast(contexts(spark, sf_dir), lambda: forecast.SeasonalNaive(M), H, ["item", "channel", "origin"])
    return forecast.long_form(made, ["item", "channel", "origin"])


@query(PANEL + f", f AS (SELECT *, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY item, channel, origin ORDER BY t ROWS UNBOUNDED PRECEDING), first_value(y IGNORE NULLS) OVER (PARTITION BY item, channel, origin ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS x FROM (SELECT w.item, p.channel, w.origin, p.t, p.y FROM wins w JOIN panel p ON p.item = w.item AND p.t >= w.origin - {L} AND p.t < w.origin)), e2 AS (SELECT item, channel, origin, max_by(x, t) AS b, min_by(x, t) AS a FROM f GROUP BY 1, 2, 3) SELECT item, channel, origin, CAST(h AS INTEGER) AS h, " + r(f"b + (b - a) / {L - 1} * (h + 1)") + f" AS yhat FROM e2, (SELECT unnest(range({H})) AS h)")
def u1_drift_forecaster(spark, sf_dir):
    return forecast.long_form(forecast.forecast(contexts(spark, sf_dir), forecast.Drift, H, ["item", "channel", "origin"]), ["item", "channel", "origin"])


@query(
    REPS
    + PAIRS
    + f", fut AS (SELECT r.ref_id, p.t - r.origin AS h, p.y FROM refs r JOIN panel p ON p.item = r.item AND p.channel = r.channel AND p.t >= r.origin AND p.t < r.origin + {H}), ok AS (SELECT ref_id FROM fut GROUP BY 1 HAVING bool_and(y IS NOT NULL)), m AS (SELECT query_id, h, avg(y) AS y FROM near JOIN ok USING (ref_id) JOIN fut USING (ref_id) WHERE rank <= {K} GROUP BY 1, 2), ctx AS (SELECT r.ref_id, p.t - r.origin AS i, coalesce(last_value(p.y IGNORE NULLS) OVER (PARTITION BY r.ref_id ORDER BY p.t ROWS UNBOUNDED PRECEDING), first_value(p.y IGNORE NULLS) OVER (PARTITION BY r.ref_id ORDER BY p.t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS x FROM refs r JOIN panel p ON p.item = r.item AND p.channel = r.channel AND p.t >= r.origin - {L} AND p.t < r.origin WHERE r.split = 'test') SELECT c.ref_id AS query_id, CAST(c.i + {M} AS INTEGER) AS h, "
    + r("coalesce(m.y, c.x)")
    + f" AS yhat FROM ctx c LEFT JOIN m ON m.query_id = c.ref_id AND m.h = c.i + {M} WHERE c.i >= -{M}"
)
def r4_retrieval_forecaster(spark, sf_dir):
    asked, store = references(spark, sf_dir)
    scaled = neighbours(spark, sf_dir)
    whole = store.where(F.forall("target", lambda x: x.isNotNull())).select("ref_id", "target")
    near = scaled.join(whole, "ref_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target"))), lambda x: x["target"]).alias("near"))
    rows = asked.select(F.col("ref_id").alias("query_id"), "context").join(near, "query_id", "left")
    return forecast.long_form(forecast.forecast(rows, lambda: forecast.RetrievalMean(M), H, ["query_id"], "near"), ["query_id"])


@query(f"SELECT count(*) AS hits, (SELECT count(*) FROM (SELECT DISTINCT item, origin FROM {ORIGINS} WHERE split = 'validation' AND origin % 2 = 1)) AS misses FROM {ORIGINS} WHERE split = 'validation' AND origin % 2 = 0")
def j15_cache_probe(spark, sf_dir):
    refs = prepared(spark, sf_dir, False).where("split = 'validation'").select("item", "origin")
    held = refs.where("origin % 2 = 0").withColumn("yhat", F.lit(0.0))
    hits, misses = forecast.cached(refs, held, ["item", "origin"])
    return hits.agg(F.count("*").alias("hits")).crossJoin(misses.agg(F.count("*").alias("misses")))


@query(
    PANEL
    + LONG
    + ", day AS (SELECT item, origin, sum(v / s * v / s) AS x00, sum(v / s * cv / s) AS x01, sum(cv / s * cv / s) AS x11, sum(v / s * residual / s) AS y0, sum(cv / s * residual / s) AS y1, count(DISTINCT channel || '/' || win) AS windows FROM (SELECT *, greatest(scale, 1e-8) AS s FROM long_) GROUP BY 1, 2) SELECT item, origin AS tick, "
    + ", ".join(r(f"sum({n}) OVER w") + f" AS {n}" for n in ("x00", "x01", "x11", "y0", "y1"))
    + ", CAST(sum(windows) OVER w AS BIGINT) AS windows FROM day WINDOW w AS (PARTITION BY item ORDER BY origin ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
)
def w17_sliding_statistics(spark, sf_dir):
    d = long_design(spark, sf_dir).withColumn("window", F.concat_ws("/", "channel", "window"))
    made = ridge.sliding_statistics(d, ["item"], "tick", 2, 30)
    return made.select("item", "tick", *[F.get(c, F.lit(i)).alias(n) for n, c, i in _G], "windows")


@query()
def g14_method_family(spark, sf_dir):
    return family.fit(extracted(spark, sf_dir), H, PREP.fitting_stride, KS, b=ridge.Bootstrap(replications=500))[2]


@query()
def g14_overall_choice(spark, sf_dir):
    return family.fit(extracted(spark, sf_dir), H, PREP.fitting_stride, KS, b=ridge.Bootstrap(replications=500))[3]


#: Windows that extraction can adapt: the K nearest references' futures and the window's own are whole.
_PATCHED = f", patched AS (SELECT item, channel, t, last_value(y IGNORE NULLS) OVER (PARTITION BY item, channel ORDER BY t ROWS BETWEEN {PATCH} PRECEDING AND CURRENT ROW) AS y FROM panel), refs AS"
ELIGIBLE = (
    REPS.replace("WHERE split = 'test'", "").replace(", refs AS", _PATCHED).replace("JOIN panel p", "JOIN patched p")
    + PAIRS.replace("split = 'test'", "split <> 'datastore'")
    + f", whole AS (SELECT r.ref_id, r.split, r.origin, bool_and(p.y IS NOT NULL) AS ok FROM refs r JOIN patched p ON p.item = r.item AND p.channel = r.channel AND p.t >= r.origin AND p.t < r.origin + {H} GROUP BY 1, 2, 3), nk AS (SELECT k, query_id, count(*) AS n, bool_and(ok) AS ok FROM near JOIN whole USING (ref_id), (SELECT unnest([{', '.join(map(str, KS))}]) AS k) WHERE rank <= k GROUP BY 1, 2), el AS (SELECT kk.k, w.ref_id, w.split, w.origin, w.ok AND s.msse_scale IS NOT NULL AS labelled, w.ok AND s.msse_scale IS NOT NULL AND coalesce(nk.n >= kk.k AND nk.ok, false) AS adapted FROM whole w JOIN refs r USING (ref_id) LEFT JOIN scales s ON s.item = r.item AND s.channel = r.channel AND s.origin = r.origin, (SELECT unnest([{', '.join(map(str, KS))}]) AS k) kk LEFT JOIN nk ON nk.query_id = w.ref_id AND nk.k = kk.k WHERE w.split <> 'datastore')"
)


@query(ELIGIBLE + " SELECT split, CAST(k AS INTEGER) AS k, count(*) AS total_windows, count(CASE WHEN labelled THEN 1 END) AS label_complete_windows, count(CASE WHEN adapted THEN 1 END) AS adapted_windows, count(CASE WHEN labelled AND NOT adapted THEN 1 END) AS vanilla_fallback_windows, count(CASE WHEN NOT labelled THEN 1 END) AS excluded_label_windows, count(DISTINCT origin) AS total_dates, count(DISTINCT CASE WHEN adapted THEN origin END) AS adapted_dates FROM el GROUP BY 1, 2")
def g9_coverage(spark, sf_dir):
    return extraction.coverage(extracted(spark, sf_dir), ["split"], KS)


@query(ELIGIBLE + f", n AS (SELECT query_id, avg(y) AS c, t - origin AS h FROM (SELECT near.query_id, p.y, p.t, r.origin FROM near JOIN refs r USING (ref_id) JOIN patched p ON p.item = r.item AND p.channel = r.channel AND p.t >= r.origin AND p.t < r.origin + {H} WHERE rank <= {max(KS)}) GROUP BY 1, 3) SELECT ref_id, el.split, adapted, " + r("avg(CASE WHEN adapted THEN n.c END)") + f" AS context_mean FROM el LEFT JOIN n ON n.query_id = el.ref_id WHERE k = {max(KS)} GROUP BY 1, 2, 3")
def r4_extraction(spark, sf_dir):
    k = max(KS)
    rows = extracted(spark, sf_dir)
    return rows.select("ref_id", "split", extraction.adapted(k).alias("adapted"), F.when(extraction.adapted(k), vectors.mean(F.col(f"context_{k}"))).alias("context_mean"))


@query(ELIGIBLE + f" SELECT w.split, CAST(CASE WHEN coalesce(nk.n, 0) < {max(KS)} THEN 1 WHEN NOT w.ok THEN 2 WHEN NOT nk.ok THEN 5 WHEN s.msse_scale IS NULL THEN 6 ELSE 0 END AS INTEGER) AS reason, count(*) AS rows_ FROM whole w JOIN refs r USING (ref_id) LEFT JOIN scales s ON s.item = r.item AND s.channel = r.channel AND s.origin = r.origin LEFT JOIN nk ON nk.query_id = w.ref_id AND nk.k = {max(KS)} WHERE w.split <> 'datastore' GROUP BY 1, 2")
def g35_extraction_reasons(spark, sf_dir):
    return extracted(spark, sf_dir).groupBy("split", "reason").agg(F.count("*").alias("rows_"))


@query()
def g9_statistics_grid(spark, sf_dir):
    made = family.statistics(extracted(spark, sf_dir), KS)
    return made.select("item", "channel", "split", "k", F.posexplode("xtx").alias("place", "x"), "yy", "rows", "windows").withColumnRenamed("rows", "rows_")


@query()
def g15_family_forecasts(spark, sf_dir):
    rows = extracted(spark, sf_dir)
    shared, single, _, _ = family.fit(rows, H, PREP.fitting_stride, KS, b=ridge.Bootstrap(replications=500))
    made = family.forecasts(rows.where("split = 'test'"), shared, single, KS)
    return made.groupBy("method", "k", "alpha").agg(F.avg("msse").alias("msse"), F.count_if("fallback").alias("fallback"), F.count("*").alias("eligible"))


@query(REPS + PAIRS + " SELECT k, query_id, count(*) AS neighbours, " + r("max(euclid)") + " AS farthest FROM near, (SELECT unnest([1, 2, 3]) AS k) WHERE rank <= k GROUP BY 1, 2")
def s2_prefix_neighbours(spark, sf_dir):
    near = neighbours(spark, sf_dir)
    each = near.select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k")).where("rank <= k")
    return each.groupBy("k", "query_id").agg(F.count("*").alias("neighbours"), F.max("distance").alias("farthest"))


@query(PANEL + f"SELECT w.item, p.channel, w.origin, count(*) AS n, " + r("avg(p.filled)") + f" AS mean FROM wins w JOIN filled p ON p.item = w.item AND p.t >= w.origin - 512 AND p.t < w.origin + {H} GROUP BY 1, 2, 3")
def c15_long_context_windows(spark, sf_dir):
    refs = prepared(spark, sf_dir).where("split = 'test'").drop("split", "tick")
    m = windows.materialise(refs, series.arrays(series.forward_fill(hourly_panel(spark, sf_dir)), "filled"), 512, H)
    whole = F.concat("context", "target")
    return m.select("item", "channel", "origin", F.size(whole).cast("long").alias("n"), vectors.mean(whole).alias("mean"))


def task_windows(spark, sf_dir) -> DataFrame:
    """Test windows of the panel with context, target and scale."""
    scales = series.prefix_scales(hourly_panel(spark, sf_dir), M).select(*SERIES, "origin", F.col("mase_scale").alias("scale"))
    return references(spark, sf_dir)[0].join(scales, [*SERIES, "origin"], "left").withColumn("window", F.floor((F.col("origin") - (HOURS - TEST)) / H).cast("int"))


_CONTEXT = f", f AS (SELECT *, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY item, channel, win ORDER BY t ROWS UNBOUNDED PRECEDING), first_value(y IGNORE NULLS) OVER (PARTITION BY item, channel, win ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS x FROM (SELECT w.item, p.channel, w.win, w.origin, p.t, p.y FROM wins w JOIN panel p ON p.item = w.item AND p.t >= w.origin - {L} AND p.t < w.origin)), ev AS (SELECT f.item, f.channel, f.win, p.y, f.x AS yhat, s.mase_scale AS scale FROM f JOIN panel p ON p.item = f.item AND p.channel = f.channel AND p.t = f.t + {M} JOIN scales s ON s.item = f.item AND s.channel = f.channel AND s.origin = f.origin WHERE f.t >= f.origin - {M}), wm AS (SELECT item, channel, win, avg(abs(y - yhat)) AS mae, avg(abs(y - yhat)) / max(scale) AS mase, avg((y - yhat) * (y - yhat)) AS mse FROM ev WHERE y IS NOT NULL GROUP BY 1, 2, 3)"


@query(PANEL + _CONTEXT + " SELECT item, channel, win, " + ", ".join(r(m) + f" AS {m}" for m in ("mae", "mase", "mse")) + ", false AS fallback FROM wm")
def r1_evaluated_task(spark, sf_dir):
    cells, _ = evaluation.evaluate(lambda: forecast.SeasonalNaive(M), task_windows(spark, sf_dir), H, lambda: forecast.SeasonalNaive(M))
    return cells.select("item", "channel", F.col("window").alias("win"), "mae", "mase", "mse", "fallback")


@query(
    PANEL
    + _CONTEXT
    + ", us AS (SELECT metric, " + r("avg(v)") + " AS mean, count(v) AS defined, count(*) AS cells FROM (UNPIVOT (SELECT mae, mase, mse FROM wm) ON mae, mase, mse INTO NAME metric VALUE v) GROUP BY 1) SELECT us.*, (SELECT count(*) FROM wm WHERE channel = 1) AS fallback, (SELECT count(*) FROM wm) AS eligible, " + r("(SELECT count(*) FROM wm WHERE channel = 1) / CAST((SELECT count(*) FROM wm) AS DOUBLE)") + " AS fallback_rate FROM us"
)
def r7_point_evaluation(spark, sf_dir):
    """Point forecasts of which those of one channel are not finite, so that they fall back."""
    rows = task_windows(spark, sf_dir)
    plain = forecast.forecast(rows, lambda: forecast.SeasonalNaive(M), H, metrics.WINDOW)
    broken = F.when(F.col("channel") == 1, F.transform("yhat", lambda x, i: F.when(i == 3, float("nan")).otherwise(x))).otherwise(F.col("yhat"))
    made = rows.select(*metrics.WINDOW, "target", "scale").join(plain.select(*metrics.WINDOW, F.col("yhat").alias("vanilla"), broken.alias("yhat")), metrics.WINDOW)
    return evaluation.evaluate_points(made)[1].where(F.col("metric").isin("mae", "mase", "mse"))
