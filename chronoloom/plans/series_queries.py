"""Queries of scans, window planning, time functions, metrics, audits and screening over an hourly panel of events."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns, vectors
from ..operators import audit, features, metrics, screening, series, windows
from ..operators.series import SERIES
from ..sources import tables
from ..sources.stages import shared_dir, stored
from .registry import query, r, table

#: The panel's hours, counted from its start in seconds; an event outside them is an error.  Parts and windows of its series.
HOURS, START = 720, 1704067200
#: Users of a cohort: series are event types within cohorts, so that there are more of them where there are more users.
COHORT = 150
TEST, VAL, H, L, M = 96, 96, 24, 48, 24
PREP = windows.Preparation(test_length=TEST, horizon=H, context=L, period=24, fitting_stride=23, datastore_stride=24)

_ITEM = f"event_type || '-' || CAST(user_id // {COHORT} AS VARCHAR)"
PANEL = f"""WITH e AS (SELECT {_ITEM} AS item, CAST(floor((epoch_us(ts) - {START}000000) / 3600000000.0) AS BIGINT) AS t, CAST(round(value * 100) AS BIGINT) AS c, value FROM events),
agg AS (SELECT item, t, CAST(sum(c) AS DOUBLE) / 100 AS s, max(value) AS m FROM e GROUP BY item, t),
grid AS (SELECT item, channel, t FROM (SELECT DISTINCT item FROM e) i, (SELECT unnest([0, 1]) AS channel) v, (SELECT unnest(range({HOURS})) AS t) h),
panel AS (SELECT g.item, g.channel, g.t, CASE WHEN g.channel = 0 THEN s ELSE m END AS y FROM grid g LEFT JOIN agg USING (item, t)),
filled AS (SELECT *, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY item, channel ORDER BY t ROWS UNBOUNDED PRECEDING), first_value(y IGNORE NULLS) OVER (PARTITION BY item, channel ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS filled FROM panel),
d AS (SELECT *, y - lag(y, {M}) OVER (PARTITION BY item, channel ORDER BY t) AS diff FROM filled),
scales AS (SELECT item, channel, t + 1 AS origin, nullif(sum(abs(diff)) OVER w / nullif(count(diff) OVER w, 0), 0) AS mase_scale, nullif(sqrt(sum(diff * diff) OVER w / nullif(count(diff) OVER w, 0)), 0) AS msse_scale FROM d WINDOW w AS (PARTITION BY item, channel ORDER BY t ROWS UNBOUNDED PRECEDING)),
wins AS (SELECT item, CAST(k AS INTEGER) AS win, {HOURS - TEST} + k * {H} AS origin FROM (SELECT DISTINCT item FROM e) i, (SELECT unnest(range({TEST // H})) AS k) w),
cells AS (SELECT w.item, p.channel, w.win, w.origin, CAST(h AS INTEGER) AS h, p.y, f.filled AS yhat, s.mase_scale AS scale FROM wins w, (SELECT unnest(range({H})) AS h) hh JOIN panel p ON p.item = w.item AND p.t = w.origin + h JOIN filled f ON f.item = p.item AND f.channel = p.channel AND f.t = w.origin - {M} + h % {M} JOIN scales s ON s.item = p.item AND s.channel = p.channel AND s.origin = w.origin)
"""


def _hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    hour = F.when((hour >= 0) & (hour < HOURS) & (F.col("ts") >= F.lit("2024-01-01")), hour).otherwise(F.raise_error(F.lit("an event lies outside the panel's hours")).cast("long"))
    item = F.concat("event_type", F.lit("-"), F.floor(F.col("user_id") / COHORT).cast("string"))
    e = table(spark, sf_dir, "events").select(item.alias("item"), hour.alias("t"), F.round(F.col("value") * 100).cast("long").alias("c"), "value")
    hours = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HOURS - 1).cast("long"))).alias("t")
    empty = e.select("item").distinct().select("item", hours, F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("value"))
    agg = e.where("item is not null").unionByName(empty).groupBy("item", "t").agg((F.sum("c").cast("double") / 100).alias("s"), F.max("value").alias("m"))
    return agg.select("item", "t", F.posexplode(F.array("s", "m")).alias("channel", "y")).select("item", "channel", "t", "y")


def hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item (event type and cohort of users), channel (0: sum, 1: largest value), t (hour), y: every hour, null where nothing happened; worked out once."""
    return stored(spark, f"{sf_dir}/events.parquet", "panel", lambda: _hourly_panel(spark, sf_dir))


def filled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.forward_fill(hourly_panel(spark, sf_dir))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda: windows.lengths(hourly_panel(spark, sf_dir)).withColumn("start_tick", F.lit(START // 3600))
    return stored(spark, f"{sf_dir}/events.parquet", "lengths", made)


def test_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.holdout_windows(lengths(spark, sf_dir), TEST, VAL, H).where("split = 'test'").drop("split")


def naive_cells(spark: SparkSession, sf_dir: str, wins: DataFrame | None = None) -> DataFrame:
    """Targets, seasonal-naive forecasts and scales of the official windows, or of those given."""
    panel, wins = hourly_panel(spark, sf_dir), test_windows(spark, sf_dir) if wins is None else wins
    points = metrics.seasonal_naive(series.forward_fill(panel), wins, M, H)
    truth = metrics.actuals(panel, wins, H).drop("origin")
    scales = series.prefix_scales(panel, M).select(*SERIES, "origin", F.col("mase_scale").alias("scale"))
    return points.join(truth, [*metrics.WINDOW, "h"]).join(scales, [*SERIES, "origin"])


# Scans and projections


@query("SELECT user_id AS item, event_type AS variate, count(*) AS steps, min(ts) AS start, count(value) AS observed FROM events GROUP BY 1, 2")
def a2_series_items(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), "ts", F.col("event_type").alias("column"), F.col("value").alias("y"))
    made = tables.items(e, "H").select("item_id", "start", F.arrays_zip("variate_names", "target").alias("z"))
    one = made.select("item_id", F.explode("z").alias("z")).select(F.col("item_id").cast("long").alias("item"), F.col("z.variate_names").alias("variate"), F.size("z.target").cast("long").alias("steps"), F.size(vectors.present(F.col("z.target"))).cast("long").alias("observed"))
    start = e.groupBy(F.col("file").cast("long").alias("item"), F.col("column").alias("variate")).agg(F.min("ts").alias("start"))
    return one.join(start, ["item", "variate"]).select("item", "variate", "steps", "start", "observed")


@query(PANEL + "SELECT CASE channel WHEN 0 THEN 'total' ELSE 'largest' END AS variate, count(*) AS steps, count(y) AS observed, " + r("sum(y)") + " AS total, TIMESTAMP '2024-01-01' AS start FROM panel GROUP BY 1")
def a1_csv_scan(spark, sf_dir):
    """Series written as CSV files and scanned again."""
    at = F.timestamp_seconds(F.lit(START) + F.col("t") * 3600)
    wide = hourly_panel(spark, sf_dir).groupBy("item", "t").pivot("channel", [0, 1]).agg(F.first("y"))
    path = f"{shared_dir(spark)}/chronoloom-csv-{uuid.uuid4().hex}"
    wide.select(F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("0").alias("total"), F.col("1").alias("largest")).write.csv(path, header=True)
    long = tables.scan_csv(spark, f"{path}/*.csv")
    return long.groupBy(F.col("column").alias("variate")).agg(F.count("*").alias("steps"), F.count("y").alias("observed"), F.sum("y").alias("total"), F.min("ts").cast("timestamp_ntz").alias("start"))


@query(PANEL + "SELECT item, channel, count(*) AS n, " + r("sum(y)") + " AS total FROM panel GROUP BY 1, 2")
def a10_stage_store(spark, sf_dir):
    """A stage's table written, which must not be there yet, and opened again."""
    path = f"{shared_dir(spark)}/chronoloom-stage-{uuid.uuid4().hex}"
    tables.write_stage(hourly_panel(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy(*SERIES).agg(F.count("*").alias("n"), F.sum("y").alias("total"))


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def a13_report(spark, sf_dir):
    """A small report written as CSV and read again."""
    path = f"{shared_dir(spark)}/chronoloom-report-{uuid.uuid4().hex}"
    tables.write_report(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n")), path)
    return spark.read.schema("kind string, n long").csv(path, header=True)


@query("SELECT o_orderpriority AS priority, count(*) AS n, " + r("sum(o_totalprice)") + " AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def a3_columnar_scan(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))
    return o.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query(PANEL + "SELECT item, channel, t, " + r("y") + f" AS y FROM panel WHERE t >= {HOURS - 24}")
def a7_long_panel_tail(spark, sf_dir):
    return series.last_rows(hourly_panel(spark, sf_dir), 24)


def item_frame(spark, sf_dir) -> DataFrame:
    arrays = series.arrays(hourly_panel(spark, sf_dir))
    agg = arrays.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("channel", "values"))).alias("c"))
    return agg.select(F.col("item").alias("item_id"), F.transform("c", lambda x: x["values"]).alias("target"), F.when(F.col("item").startswith("view-"), F.array(F.lit("total"), F.lit("largest"))).alias("variate_names"))


@query(PANEL + "SELECT item, channel, CASE WHEN item LIKE 'view-%' THEN CASE channel WHEN 0 THEN 'total' ELSE 'largest' END ELSE 'dim_' || channel END AS name, count(*) AS n, count(y) AS observed, " + r("sum(y)") + " AS total FROM panel GROUP BY 1, 2, 3")
def a8_items_to_panel(spark, sf_dir):
    p = tables.panel_of(item_frame(spark, sf_dir))
    return p.groupBy("item", "channel", "name").agg(F.count("*").alias("n"), F.count("y").alias("observed"), F.sum("y").alias("total"))


@query(f"SELECT item AS item_id, channel, name FROM (SELECT DISTINCT {_ITEM} AS item FROM events), (VALUES (0, 'total'), (1, 'largest')) v(channel, name) WHERE item LIKE 'view-%'")
def a9_identity_scan(spark, sf_dir):
    return tables.identities(item_frame(spark, sf_dir).where("variate_names is not null"))


@query("SELECT p_brand AS brand, max(abs(p_retailprice * 1000)) AS largest, CASE WHEN max(abs(p_retailprice * 1000)) > 60000 THEN pow(10.0, ceil(log10(max(abs(p_retailprice * 1000)) / 60000))) ELSE 1.0 END AS factor FROM part GROUP BY 1")
def a11_prediction_scale_factor(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), (F.col("p_retailprice") * 1000).alias("yhat"))
    return metrics.scale_factors(p, ["brand"])


@query(PANEL + "SELECT item || '_dim' || channel AS item_id, count(*) AS n, " + r("avg(y)") + " AS mean FROM panel GROUP BY 1")
def b1_multivariate_to_univariate(spark, sf_dir):
    u = tables.univariate(item_frame(spark, sf_dir))
    return u.select("item_id", F.size("values").cast("long").alias("n"), vectors.mean(F.col("values")).alias("mean"))


@query(PANEL + "SELECT item || '_dim' || channel AS item_id, 1 AS covariates, (SELECT " + r("avg(q.y)") + " FROM panel q WHERE q.item = p.item AND q.channel <> p.channel) AS other_mean FROM (SELECT DISTINCT item, channel FROM panel) p")
def b2_other_variates_as_covariates(spark, sf_dir):
    u = tables.univariate_with_others(item_frame(spark, sf_dir))
    return u.select("item_id", F.size("covariates").alias("covariates"), vectors.mean(F.get("covariates", F.lit(0))).alias("other_mean"))


@query("SELECT event_type AS item, CASE WHEN isinf(v) AND v > 0 THEN 'posinf' WHEN isinf(v) THEN 'neginf' WHEN v IS NULL OR isnan(v) THEN 'nan' ELSE 'finite' END AS kind, count(*) AS n FROM (SELECT event_type, CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN CAST('nan' AS DOUBLE) WHEN 2 THEN CAST('inf' AS DOUBLE) WHEN 3 THEN CAST('-inf' AS DOUBLE) ELSE value END AS v FROM events) GROUP BY 1, 2")
def b4_value_kinds(spark, sf_dir):
    k = F.col("event_id") % 10
    v = F.when(k == 0, None).when(k == 1, float("nan")).when(k == 2, float("inf")).when(k == 3, -float("inf")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("item"), columns.kind(v).alias("kind")).groupBy("item", "kind").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(CASE WHEN json_extract_string(props, '$.k') = '42' THEN 1 END) AS matching FROM events")
def b10_json_path_filter(spark, sf_dir):
    test = columns.matches_filters(F.col("props"), columns.parse_filters(["k=42"]))
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_if(test).alias("matching"))


@query(PANEL + "SELECT item, channel, count(*) AS n, " + r("sum(y)") + " AS total FROM panel WHERE channel = 0 AND item <> 'error-0' GROUP BY 1, 2")
def b13_drop_variates(spark, sf_dir):
    p = screening.drop_variates(hourly_panel(spark, sf_dir), channels=[1], items=["error-0"])
    return p.groupBy(*SERIES).agg(F.count("*").alias("n"), F.sum("y").alias("total"))


@query(PANEL + f"SELECT item, channel, o AS origin, count(*) AS n, " + r("sum(y)") + f" AS total FROM panel, (SELECT unnest([10, {L}, 500]) AS o) x WHERE t >= o - least({L}, o) AND t < o GROUP BY 1, 2, 3")
def b16_context_tail(spark, sf_dir):
    a = series.arrays(hourly_panel(spark, sf_dir)).select("*", F.explode(F.array(F.lit(10), F.lit(L), F.lit(500))).alias("origin"))
    tail = vectors.tail(F.col("values"), F.col("origin"), L)
    return a.select(*SERIES, "origin", F.size(tail).cast("long").alias("n"), vectors.total(tail).alias("total"))


# Window planning

_ITEMS = f"(SELECT DISTINCT {_ITEM} AS item FROM events)"


@query(f"SELECT item, 'test' AS split, CAST(k AS INTEGER) AS win, {HOURS - TEST} + k * {H} AS origin FROM {_ITEMS}, (SELECT unnest(range({TEST // H})) AS k) UNION ALL SELECT item, 'val', CAST(k AS INTEGER), {HOURS - TEST - VAL} + k * {H} FROM {_ITEMS}, (SELECT unnest(range({VAL // H})) AS k)")
def c1_holdout_windows(spark, sf_dir):
    return windows.holdout_windows(lengths(spark, sf_dir), TEST, VAL, H).withColumnRenamed("window", "win")


_N = PREP.windows
_VAL0 = HOURS - TEST - windows.span(_N, H, 23)
_TRAIN0 = _VAL0 - windows.span(2 * _N, H, 23)
INTERVALS = f"(SELECT item, split, a AS start_, b AS stop_ FROM {_ITEMS}, (VALUES ('datastore', 0, {_TRAIN0}), ('train', {_TRAIN0}, {_VAL0}), ('validation', {_VAL0}, {HOURS - TEST}), ('test', {HOURS - TEST}, {HOURS})) v(split, a, b))"
ORIGINS = f"(SELECT item, split, unnest(range(start_ + CASE WHEN split = 'test' THEN 0 ELSE greatest(0, CAST(ceil(({L} - start_) / 23.0) AS BIGINT)) * 23 END, stop_ - {H} + 1, CASE WHEN split = 'test' THEN {H} ELSE 23 END)) AS origin FROM {INTERVALS} WHERE split <> 'datastore')"
STORE = f"(SELECT DISTINCT s.item, o AS origin FROM {INTERVALS} s, (SELECT unnest(range({HOURS})) AS o) o, (SELECT DISTINCT item, origin % 24 AS phase FROM {ORIGINS}) q WHERE s.split = 'datastore' AND q.phase = o % 24 AND o >= {L} AND o <= stop_ - {H})"


@query(f"SELECT item, split, start_ AS start, stop_ AS stop FROM {INTERVALS}")
def c2_causal_split(spark, sf_dir):
    return windows.intervals(lengths(spark, sf_dir), PREP)


@query(f"SELECT item, split, origin FROM {ORIGINS}")
def c3_query_origins(spark, sf_dir):
    return windows.query_origins(windows.intervals(lengths(spark, sf_dir), PREP), PREP)


@query(f"SELECT item, origin FROM {ORIGINS} WHERE split = 'test'")
def c4_official_origins(spark, sf_dir):
    return windows.query_origins(windows.intervals(lengths(spark, sf_dir), PREP), PREP).where("split = 'test'").select("item", "origin")


def prepared(spark, sf_dir, channels=True, p=PREP) -> DataFrame:
    s = lengths(spark, sf_dir)
    return windows.prepare(s, s.select("item", F.explode(F.array(F.lit(0), F.lit(1))).alias("channel")) if channels else None, p)


@query(f"SELECT item, origin FROM {STORE}")
def c5_datastore_origins(spark, sf_dir):
    return prepared(spark, sf_dir, False).where("split = 'datastore'").select("item", "origin")


@query(f"SELECT DISTINCT (origin + {START // 3600}) % 24 AS residue FROM {ORIGINS}")
def c6_query_residues(spark, sf_dir):
    return windows.residues(prepared(spark, sf_dir, False).where("split <> 'datastore'"), 24)


@query(f"SELECT item, channel, split, origin, origin + {START // 3600} AS tick FROM (SELECT item, split, origin FROM {ORIGINS} UNION ALL SELECT item, 'datastore', origin FROM {STORE}), (SELECT unnest([0, 1]) AS channel)")
def c7_references(spark, sf_dir):
    return prepared(spark, sf_dir).select("item", "channel", "split", "origin", "tick")


@query(f"SELECT item, channel, origin FROM (SELECT item, channel, origin, row_number() OVER (PARTITION BY item, channel ORDER BY origin DESC) AS r FROM {STORE}, (SELECT unnest([0, 1]) AS channel)) WHERE r <= 5")
def c8_recent_cap(spark, sf_dir):
    return windows.recent_cap(prepared(spark, sf_dir).where("split = 'datastore'"), 5, False).select("item", "channel", "origin")


@query(f"SELECT item, channel, origin FROM (SELECT item, channel, origin, row_number() OVER (PARTITION BY item, channel ORDER BY origin DESC) AS r FROM {STORE}, (SELECT unnest([0, 1]) AS channel)) WHERE r <= (SELECT 73 // (2 * count(*)) FROM {_ITEMS})")
def c9_shared_cap(spark, sf_dir):
    return windows.recent_cap(prepared(spark, sf_dir).where("split = 'datastore'"), 73, True, needed=False).select("item", "channel", "origin")


@query(f"SELECT min(n) AS least_dates FROM (SELECT item, count(*) AS n FROM {STORE} GROUP BY 1)")
def c10_least_dates(spark, sf_dir):
    return windows.least_dates(prepared(spark, sf_dir).where("split = 'datastore'"))


@query(f"SELECT split, count(*) AS refs, min(origin) AS first_origin, max(origin) AS last_origin FROM (SELECT item, split, origin FROM {ORIGINS} UNION ALL SELECT item, 'datastore', origin FROM {STORE}), (SELECT unnest([0, 1]) AS channel) GROUP BY 1")
def c11_preparation_summary(spark, sf_dir):
    return prepared(spark, sf_dir).groupBy("split").agg(F.count("*").alias("refs"), F.min("origin").alias("first_origin"), F.max("origin").alias("last_origin"))


@query(f"SELECT query_id, item, origin FROM (SELECT q.item || '/' || q.origin AS query_id, s.item, x AS origin, row_number() OVER (PARTITION BY q.item, q.origin, s.item ORDER BY x DESC) AS r FROM (SELECT * FROM {ORIGINS} WHERE split = 'test') q JOIN {_ITEMS} s ON s.item = q.item, (SELECT unnest(range({HOURS})) AS x) x WHERE x >= {L} AND x <= q.origin - {H} AND (q.origin - {H} - (q.origin - {H} - q.origin % 24) % 24 - x) % 23 = 0 AND (q.origin - {H} - x) >= 0) WHERE r <= 6")
def c12_rolling_origins(spark, sf_dir):
    ask = prepared(spark, sf_dir, False).where("split = 'test'").select(F.concat_ws("/", "item", F.col("origin").cast("string")).alias("query_id"), "item", "tick")
    return windows.rolling_origins(ask, lengths(spark, sf_dir), PREP, 6, PREP.fitting_stride)


@query(PANEL + f"SELECT w.item, p.channel, w.origin, " + r(f"sum(CASE WHEN p.t < w.origin THEN y END)") + " AS context_sum, " + r("sum(CASE WHEN p.t >= w.origin THEN y END)") + f" AS target_sum, count(*) AS n FROM wins w JOIN panel p ON p.item = w.item AND p.t >= w.origin - {L} AND p.t < w.origin + {H} GROUP BY 1, 2, 3")
def c13_materialised_windows(spark, sf_dir):
    refs = prepared(spark, sf_dir).where("split = 'test'").drop("split", "tick")
    m = windows.materialise(refs, series.arrays(hourly_panel(spark, sf_dir)), L, H)
    return m.select("item", "channel", "origin", vectors.total(F.col("context")).alias("context_sum"), vectors.total(F.col("target")).alias("target_sum"), (F.size("context") + F.size("target")).cast("long").alias("n"))


@query(PANEL + f"SELECT w.item, c AS channel, w.origin, p.channel AS other, " + r("avg(p.y)") + f" AS past_mean FROM wins w, (SELECT unnest([0, 1]) AS c) cc JOIN panel p ON p.item = w.item AND p.channel <> c AND p.t >= w.origin - {L} AND p.t < w.origin GROUP BY 1, 2, 3, 4")
def c14_other_variates(spark, sf_dir):
    refs = prepared(spark, sf_dir).where("split = 'test'").select("item", "channel", "origin")
    o = windows.other_variates(refs, series.arrays(hourly_panel(spark, sf_dir)), L)
    return o.select("item", "channel", "origin", "other", vectors.mean(F.col("past")).alias("past_mean"))


@query(PANEL + f"SELECT item, channel, count(*) AS n, count(y) AS observed, " + r("sum(y)") + f" AS total FROM (SELECT i.item, i.channel, x, p.y FROM (SELECT DISTINCT item, channel FROM panel) i, (SELECT unnest(range({HOURS - 12 - L}, {HOURS - 12 + H})) AS x) x LEFT JOIN panel p ON p.item = i.item AND p.channel = i.channel AND p.t = x) GROUP BY 1, 2")
def c16_covariate_window(spark, sf_dir):
    a = series.arrays(hourly_panel(spark, sf_dir))
    w = windows.covariate_window(F.col("values"), F.lit(HOURS - 12), L, H)
    return a.select(*SERIES, F.size(w).cast("long").alias("n"), F.size(vectors.present(w)).cast("long").alias("observed"), vectors.total(w).alias("total"))


@query(PANEL + "SELECT min(n) AS min_length, max(n) AS max_length, avg(n) AS avg_length, CAST(sum(n) AS BIGINT) AS sum_length, count(*) AS series FROM (SELECT item, max(t) + 1 AS n FROM panel GROUP BY 1)")
def c17_length_summary(spark, sf_dir):
    return windows.length_summary(lengths(spark, sf_dir))


@query(f"SELECT split, CASE WHEN split = 'datastore' THEN least(n, 5) * s ELSE n * s END AS refs, CASE WHEN split = 'datastore' THEN least(n, 5) ELSE n END AS dates, CASE WHEN split = 'datastore' THEN greatest(n - 5, 0) * s ELSE 0 END AS cap_removed, items AS series, 0 AS excluded_series FROM (SELECT split, count(DISTINCT origin) AS n FROM (SELECT item, split, origin FROM {ORIGINS} UNION ALL SELECT item, 'datastore', origin FROM {STORE}) GROUP BY 1), (SELECT count(*) AS items, 2 * count(*) AS s FROM {_ITEMS})")
def c11_preparation_report(spark, sf_dir):
    s = lengths(spark, sf_dir)
    return windows.preparation_report(s, s.select("item", F.explode(F.array(F.lit(0), F.lit(1))).alias("channel")), dataclasses.replace(PREP, cap=5))


# Functions along time


@query(PANEL + "SELECT item, channel, t, " + r("filled") + " AS filled FROM filled")
def w1_forward_fill(spark, sf_dir):
    return filled_panel(spark, sf_dir).drop("y")


@query(PANEL + f"SELECT item, channel, " + r("nullif(avg(abs(diff)), 0)") + " AS mase_scale, " + r("nullif(sqrt(avg(diff * diff)), 0)") + " AS msse_scale, count(diff) AS pairs FROM d GROUP BY 1, 2")
def w3_seasonal_scales(spark, sf_dir):
    return series.seasonal_scales(hourly_panel(spark, sf_dir), M)


@query(PANEL + "SELECT item, channel, origin, " + r("mase_scale") + " AS mase_scale, " + r("msse_scale") + " AS msse_scale FROM scales")
def w4_prefix_scales(spark, sf_dir):
    return series.prefix_scales(hourly_panel(spark, sf_dir), M)


@query(PANEL + "SELECT item, channel, t, CAST(sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) AS nan_upto, CAST(0 AS BIGINT) AS posinf_upto, CAST(0 AS BIGINT) AS neginf_upto, CAST(sum(c) OVER w AS BIGINT) AS changes_upto FROM (SELECT *, CASE WHEN t > 0 AND y IS DISTINCT FROM lag(y) OVER (PARTITION BY item, channel ORDER BY t) THEN 1 ELSE 0 END AS c FROM panel) WINDOW w AS (PARTITION BY item, channel ORDER BY t ROWS UNBOUNDED PRECEDING)")
def w5_audit_counters(spark, sf_dir):
    return series.audit_counters(hourly_panel(spark, sf_dir))


@query(
    PANEL
    + "SELECT item, channel, t, "
    + r("coalesce(CASE WHEN ta = tb THEN a ELSE a + (b - a) * (t - ta) / CAST(tb - ta AS DOUBLE) END, a, b, 0)")
    + " AS filled FROM (SELECT item, channel, t, last_value(y IGNORE NULLS) OVER p AS a, first_value(y IGNORE NULLS) OVER f AS b, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER p AS ta, first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER f AS tb FROM panel WINDOW p AS (PARTITION BY item, channel ORDER BY t ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY item, channel ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
)
def w6_linear_interpolation(spark, sf_dir):
    return series.interpolate(hourly_panel(spark, sf_dir)).drop("y")


@query(PANEL + "SELECT item, channel, t, " + r("quantile_cont(filled, 0.5) OVER w") + " AS median, " + r("quantile_cont(filled, 0.75) OVER w - quantile_cont(filled, 0.25) OVER w") + " AS iqr FROM filled WINDOW w AS (PARTITION BY item, channel ORDER BY t ROWS BETWEEN 36 PRECEDING AND 35 FOLLOWING)")
def w7_rolling_median_iqr(spark, sf_dir):
    return series.rolling_median_iqr(filled_panel(spark, sf_dir), 72).drop("y", "filled")


@query(PANEL + "SELECT x.item, x.channel, a + k AS t, " + r("y") + " AS y FROM (SELECT item, channel, min(t) AS a, max(t) AS b FROM panel WHERE y IS NOT NULL GROUP BY 1, 2) x, (SELECT unnest(range(720)) AS k) k LEFT JOIN panel p ON p.item = x.item AND p.channel = x.channel AND p.t = a + k WHERE a + k <= b")
def w8_gap_fill(spark, sf_dir):
    return series.regular(hourly_panel(spark, sf_dir).where("y is not null"))


@query("SELECT item, weekday FROM (SELECT item, weekday, row_number() OVER (PARTITION BY item ORDER BY n DESC, weekday) AS r FROM (SELECT o_orderpriority AS item, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS weekday, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE r = 1")
def w9_weekday_anchor(spark, sf_dir):
    return series.anchor_weekday(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("item"), F.col("o_orderdate").alias("ts")), ["item"])


@query(PANEL + "SELECT item, channel, count(DISTINCT gap) = 1 AS regular, CASE WHEN count(DISTINCT gap) = 1 THEN min(gap) END AS step FROM (SELECT item, channel, t - lag(t) OVER (PARTITION BY item, channel ORDER BY t) AS gap FROM panel WHERE y IS NOT NULL) GROUP BY 1, 2")
def w10_constant_gap(spark, sf_dir):
    return series.constant_gap(hourly_panel(spark, sf_dir))


@query(PANEL + "SELECT item, channel, block, count(*) AS n, " + r("avg(filled)") + " AS mean FROM (SELECT *, CAST(ntile(7) OVER (PARTITION BY item, channel ORDER BY t) AS INTEGER) AS block FROM filled) GROUP BY 1, 2, 3")
def w11_chronological_blocks(spark, sf_dir):
    return series.blocks(filled_panel(spark, sf_dir), 7).groupBy(*SERIES, "block").agg(F.count("*").alias("n"), F.avg("filled").alias("mean"))


@query(PANEL + "SELECT item, channel, " + r("avg(d1)") + " AS mean, " + r("stddev_samp(d1)") + " AS sd FROM (SELECT item, channel, filled - lag(filled) OVER (PARTITION BY item, channel ORDER BY t) AS d1 FROM filled) GROUP BY 1, 2")
def w12_first_difference(spark, sf_dir):
    return series.first_difference(filled_panel(spark, sf_dir)).groupBy(*SERIES).agg(F.avg("diff1").alias("mean"), F.stddev_samp("diff1").alias("sd"))


_DEV = "dev AS (SELECT *, filled - avg(filled) OVER (PARTITION BY item, channel) AS dv FROM filled), lags AS (SELECT *, " + ", ".join(f"lag(dv, {k}) OVER (PARTITION BY item, channel ORDER BY t) AS l{k}" for k in range(1, 21)) + " FROM dev)"


@query(PANEL + ", " + _DEV + ", acf AS (SELECT item, channel, count(*) AS n, " + ", ".join(f"sum(dv * l{k}) / ((count(*) - {k}) * var_pop(filled)) AS acf{k}" for k in range(1, 11)) + " FROM lags GROUP BY 1, 2) SELECT item, channel, n, " + ", ".join(r(f"acf{k}") + f" AS acf{k}" for k in range(1, 10)) + ", " + r("+".join(f"acf{k} * acf{k}" for k in range(1, 11))) + " AS acf10 FROM acf")
def w13_autocorrelation(spark, sf_dir):
    return series.autocorrelation(filled_panel(spark, sf_dir))


@query(PANEL + f", u AS (SELECT item, channel, t // {M} AS cycle, t % {M} AS phase, filled - avg(filled) OVER w AS c FROM filled WINDOW w AS (PARTITION BY item, channel, t // {M})), v AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY item, channel, cycle)) AS z FROM u), s AS (SELECT item, channel, phase, sum(z) AS s, count(*) AS n FROM v GROUP BY 1, 2, 3) SELECT item, channel, max(n) AS cycles, " + r("(sum(s * s) - max(n)) / (max(n) * (max(n) - 1))") + " AS seasonal_corr FROM s GROUP BY 1, 2")
def w14_cycle_correlation(spark, sf_dir):
    return series.cycle_correlation(filled_panel(spark, sf_dir), M)


@query("SELECT event_type AS item, " + r("avg(value)") + " AS mean, CAST(rank() OVER (ORDER BY round(avg(value), 6) DESC) AS INTEGER) AS mean_rank FROM events GROUP BY 1")
def w15_feature_ranks(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("item")).agg(F.round(F.avg("value"), 6).alias("mean"))
    return features.ranks(m, "mean")


# Metrics


@query(
    PANEL
    + "SELECT item, channel, win, "
    + ", ".join(
        r(x) + f" AS {n}"
        for n, x in {
            "mse": "avg((y - yhat) * (y - yhat))",
            "mae": "avg(abs(y - yhat))",
            "rmse": "sqrt(avg((y - yhat) * (y - yhat)))",
            "mape": "avg(CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END)",
            "smape": "avg(CASE WHEN abs(y) + abs(yhat) > 0 THEN 2 * abs(y - yhat) / (abs(y) + abs(yhat)) ELSE 0 END)",
            "mase": "avg(abs(y - yhat)) / max(scale)",
            "nd": "sum(abs(y - yhat)) / nullif(sum(abs(y)), 0)",
        }.items()
    )
    + " FROM cells WHERE y IS NOT NULL GROUP BY 1, 2, 3"
)
def g1_window_metrics(spark, sf_dir):
    return metrics.window_metrics(naive_cells(spark, sf_dir)).withColumnRenamed("window", "win")


_Z = {0.1: -1.2815515655446008, 0.5: 0.0, 0.9: 1.2815515655446008}


def quantile_cells(spark, sf_dir) -> DataFrame:
    cells = naive_cells(spark, sf_dir)
    sigma = series.seasonal_scales(hourly_panel(spark, sf_dir), M).select(*SERIES, F.col("msse_scale").alias("sigma"))
    bands = metrics.naive_quantiles(cells.select(*metrics.WINDOW, "h", "yhat"), sigma, M, sorted(_Z))
    return bands.join(cells.select(*metrics.WINDOW, "h", "y"), [*metrics.WINDOW, "h"])


_BANDS = "sig AS (SELECT item, channel, sqrt(avg(diff * diff)) AS sigma FROM d GROUP BY 1, 2), bands AS (SELECT c.item, c.channel, c.win, c.h, c.y, q.quantile, yhat + z * sigma AS yhat FROM cells c JOIN sig USING (item, channel), (VALUES " + ", ".join(f"(CAST({q} AS DOUBLE), CAST({z} AS DOUBLE))" for q, z in _Z.items()) + ") q(quantile, z))"


@query(PANEL + ", " + _BANDS + ", loss AS (SELECT item, channel, win, quantile, sum(2 * abs((y - yhat) * (CASE WHEN yhat >= y THEN 1.0 ELSE 0.0 END - quantile))) / nullif(sum(abs(y)), 0) AS v FROM bands WHERE y IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT item, channel, win, " + r("avg(v)") + " AS crps FROM loss GROUP BY 1, 2, 3")
def g1_crps(spark, sf_dir):
    return metrics.crps(quantile_cells(spark, sf_dir)).withColumnRenamed("window", "win")


@query(PANEL + "SELECT item, channel, win, count(y) AS support, count(y) > 0 AND bool_and(y IS NULL OR yhat IS NOT NULL) AND max(scale) IS NOT NULL AS in_grid FROM cells GROUP BY 1, 2, 3")
def g2_evaluation_grid(spark, sf_dir):
    return metrics.evaluation_grid(naive_cells(spark, sf_dir)).withColumnRenamed("window", "win")


@query(PANEL + ", m AS (SELECT item, channel, win, avg(abs(y - yhat)) AS mae, avg(abs(y - yhat)) / max(scale) AS mase FROM cells WHERE y IS NOT NULL GROUP BY 1, 2, 3) SELECT 'mae' AS metric, " + r("avg(mae)") + " AS mean, count(mae) AS defined, count(*) AS cells FROM m UNION ALL SELECT 'mase', " + r("avg(mase)") + ", count(mase), count(*) FROM m")
def g3_metric_summary(spark, sf_dir):
    return metrics.metric_summary(metrics.window_metrics(naive_cells(spark, sf_dir)), ["mae", "mase"])


@query(PANEL + "SELECT item, channel, win, h, " + r("yhat") + " AS yhat FROM cells")
def g4_seasonal_naive(spark, sf_dir):
    return metrics.seasonal_naive(filled_panel(spark, sf_dir), test_windows(spark, sf_dir), M, H).drop("origin").withColumnRenamed("window", "win")


@query(PANEL + ", " + _BANDS + " SELECT item, channel, win, h, quantile, " + r("yhat") + " AS yhat FROM bands")
def g5_naive_quantiles(spark, sf_dir):
    return quantile_cells(spark, sf_dir).drop("y").withColumnRenamed("window", "win")


# Audits and screening


def audit_counts(spark, sf_dir) -> DataFrame:
    w = test_windows(spark, sf_dir).select("item", "window", (F.col("origin") - L).alias("start"), F.col("origin").alias("stop"))
    return audit.interval_counts(hourly_panel(spark, sf_dir), w, ["window"])


_AUDIT = f"au AS (SELECT w.win, w.item, p.channel, w.origin - {L} AS start, w.origin AS stop, 1 AS channel_windows, count(*) AS value_count, count(y) AS finite_count, count(*) - count(y) AS nan_count, 0 AS posinf_count, 0 AS neginf_count, CAST(count(y) < count(*) AS INTEGER) AS nonfinite_windows, CAST(count(y) = count(*) AND sum(CASE WHEN p.t > w.origin - {L} AND y IS DISTINCT FROM prev THEN 1 ELSE 0 END) = 0 AS INTEGER) AS constant_windows, CAST(count(y) = 0 AS INTEGER) AS all_nonfinite_windows FROM wins w JOIN (SELECT *, lag(y) OVER (PARTITION BY item, channel ORDER BY t) AS prev FROM panel) p ON p.item = w.item AND p.t >= w.origin - {L} AND p.t < w.origin GROUP BY w.win, w.item, p.channel, w.origin)"


@query(PANEL + ", " + _AUDIT + " SELECT * FROM au")
def g20_audit_counts(spark, sf_dir):
    return audit_counts(spark, sf_dir).withColumnRenamed("window", "win")


@query(PANEL + ", " + _AUDIT + " SELECT coalesce(item, 'all') AS item, coalesce(CAST(win AS VARCHAR), 'all') AS win, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in audit.COUNTS) + " FROM au GROUP BY ROLLUP (item, win)")
def g21_audit_rollup(spark, sf_dir):
    return audit.rollup(audit_counts(spark, sf_dir).withColumn("win", F.col("window").cast("string")), "item", "win")


@query(PANEL + f"SELECT item, channel, t, TIMESTAMP '2024-01-01' + to_hours(t) AS ts, 'nan' AS kind FROM panel WHERE y IS NULL")
def g22_nonfinite_positions(spark, sf_dir):
    return audit.nonfinite_positions(hourly_panel(spark, sf_dir), "2024-01-01", 3600)


@query(PANEL + ", " + _AUDIT + " SELECT win, item, channel, start, stop, nan_count FROM au WHERE nonfinite_windows = 1 OR constant_windows = 1")
def g23_window_events(spark, sf_dir):
    return audit.events(audit_counts(spark, sf_dir)).select(F.col("window").alias("win"), *SERIES, "start", "stop", "nan_count")


@query(PANEL + ", v AS (SELECT item, channel, filled, count(*) AS n FROM filled GROUP BY 1, 2, 3), p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY item, channel) AS DOUBLE) AS p, row_number() OVER (PARTITION BY item, channel ORDER BY n DESC, filled) AS r FROM v) SELECT item, channel, " + r("sum(CASE WHEN r <= 5 THEN p END)") + " AS dominance, " + r("CASE WHEN count(*) = 1 THEN 0 ELSE -sum(p * ln(p + 1e-12)) / ln(greatest(count(*), 2)) END") + " AS entropy, sum(CASE WHEN r <= 5 THEN p END) < 0.5 AND CASE WHEN count(*) = 1 THEN 0 ELSE -sum(p * ln(p + 1e-12)) / ln(greatest(count(*), 2)) END > 0.1 AS varied FROM p GROUP BY 1, 2")
def g24_constancy(spark, sf_dir):
    return screening.constancy(filled_panel(spark, sf_dir))


@query(PANEL + "SELECT item, channel, count(*) AS length, " + r("avg(CASE WHEN y IS NULL THEN 1 ELSE 0 END)") + " AS missing_rate, count(*) >= 168 AS length_ok, avg(CASE WHEN y IS NULL THEN 1 ELSE 0 END) <= 0.2 AS missing_ok, true AS monotonic FROM panel GROUP BY 1, 2")
def g25_basic_checks(spark, sf_dir):
    return screening.basic_checks(hourly_panel(spark, sf_dir), screening.LEAST_LENGTH["H"])


@query(PANEL + ", " + _DEV + ", q AS (SELECT item, channel, count(*) AS n, sum(dv * dv) AS s, " + ", ".join(f"sum(dv * l{k}) AS p{k}" for k in range(1, 21)) + " FROM lags GROUP BY 1, 2) SELECT item, channel, n, " + ", ".join(r("n * (n + 2) * (" + "+".join(f"(p{k}/s) * (p{k}/s) / (n - {k})" for k in range(1, m + 1)) + ")") + f" AS q{m}" for m in (10, 20)) + " FROM q")
def g26_ljung_box(spark, sf_dir):
    return screening.ljung_box(filled_panel(spark, sf_dir))


@query(
    PANEL
    + ", rolled AS (SELECT *, quantile_cont(filled, 0.5) OVER w AS med, quantile_cont(filled, 0.75) OVER w - quantile_cont(filled, 0.25) OVER w AS iqr FROM filled WINDOW w AS (PARTITION BY item, channel ORDER BY t ROWS BETWEEN 36 PRECEDING AND 35 FOLLOWING)), gl AS (SELECT item, channel, quantile_cont(filled, 0.75) - quantile_cont(filled, 0.25) AS g, stddev_samp(filled) AS sd FROM filled GROUP BY 1, 2), x AS (SELECT item, channel, abs(filled - med) / CASE WHEN iqr = 0 THEN CASE WHEN g = 0 THEN nullif(sd * 1.35, 0) ELSE g END ELSE iqr END AS v FROM rolled JOIN gl USING (item, channel)) SELECT item, channel, round_even(avg(CASE WHEN v > 3 AND v < 9 THEN 1.0 ELSE 0.0 END) * 100, 2) AS transient_pct, round_even(avg(CASE WHEN v >= 9 THEN 1.0 ELSE 0.0 END) * 100, 2) AS extreme_pct, avg(CASE WHEN v >= 9 THEN 1.0 ELSE 0.0 END) <= 0.05 AS keep FROM x GROUP BY 1, 2"
)
def g27_outlier_ratios(spark, sf_dir):
    return screening.outlier_ratios(filled_panel(spark, sf_dir), 72)


@query()
def g28_screening(spark, sf_dir):
    return screening.screen(hourly_panel(spark, sf_dir), 168, 72).withColumn("checks", F.array_join("checks", ","))


@query(PANEL + "SELECT a.item || '/' || a.channel AS a, b.item || '/' || b.channel AS b, " + r("corr(a.y, b.y)") + " AS r FROM panel a JOIN panel b ON a.t = b.t AND a.item || '/' || a.channel < b.item || '/' || b.channel WHERE a.y IS NOT NULL AND b.y IS NOT NULL GROUP BY 1, 2 HAVING abs(corr(a.y, b.y)) > 0.02")
def g29_correlated_pairs(spark, sf_dir):
    return screening.correlated_pairs(hourly_panel(spark, sf_dir), False, 0.02)


@query(PANEL + ", k AS (SELECT item, channel, avg(CASE WHEN y IS NULL THEN 1 ELSE 0 END) <= 0.06 AS good, count(y) AS n FROM panel GROUP BY 1, 2) SELECT channel, CAST(sum(CAST(good AS INTEGER)) AS BIGINT) AS kept, count(*) AS total, CAST(sum(n) AS BIGINT) AS observations, " + r("sum(CAST(good AS INTEGER)) / CAST(count(*) AS DOUBLE)") + " AS ratio, CASE WHEN sum(CAST(good AS INTEGER)) / CAST(count(*) AS DOUBLE) >= 0.5 THEN 'keep' ELSE 'drop' END AS recommended FROM k GROUP BY 1")
def g30_dataset_summary(spark, sf_dir):
    p = hourly_panel(spark, sf_dir)
    good = screening.basic_checks(p, 168, 0.06).select(*SERIES, F.col("missing_ok").alias("predictable"))
    return screening.dataset_summary(good, p)


_SCREENED = "k AS (SELECT item, channel, avg(CASE WHEN y IS NULL THEN 1 ELSE 0 END) <= 0.06 AS good, count(y) AS n FROM panel GROUP BY 1, 2)"


def screened_by_missing(spark, sf_dir) -> DataFrame:
    checks = screening.basic_checks(hourly_panel(spark, sf_dir), 168, 0.06)
    return checks.select(*SERIES, F.col("missing_ok").alias("predictable"), F.when(F.col("missing_ok"), F.array().cast("array<string>")).otherwise(F.array(F.lit("missing"))).alias("checks"))


@query(PANEL + ", " + _SCREENED + " SELECT item, count(*) AS variates, 'missing' AS reasons FROM k GROUP BY 1 HAVING NOT bool_or(good)")
def g30_dropped_series(spark, sf_dir):
    return screening.dropped(screened_by_missing(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


@query(PANEL + ", " + _SCREENED + ", g AS (SELECT channel FROM k GROUP BY 1 HAVING avg(CAST(good AS INTEGER)) >= 0.5) SELECT p.item, p.channel, count(*) AS steps, " + r("sum(y)") + " AS total FROM panel p JOIN k USING (item, channel) JOIN g ON g.channel = p.channel WHERE good GROUP BY 1, 2")
def b13_drop_recommended(spark, sf_dir):
    left, _ = screening.drop_recommended(hourly_panel(spark, sf_dir), screened_by_missing(spark, sf_dir))
    return left.groupBy(*SERIES).agg(F.count("*").alias("steps"), F.sum("y").alias("total"))


# Features


@query(PANEL + "SELECT item, channel, " + r("avg(y)") + " AS mean, " + r("stddev_pop(y)") + " AS std, " + r("avg(CASE WHEN y IS NULL THEN 1 ELSE 0 END)") + " AS missing_rate, count(*) AS length FROM panel GROUP BY 1, 2")
def f1_moments(spark, sf_dir):
    return features.moments(hourly_panel(spark, sf_dir))


@query(PANEL + "SELECT item, channel, t, " + r("CASE WHEN s < 1e-8 THEN filled ELSE (filled - m) / s END") + " AS z FROM (SELECT *, avg(filled) OVER (PARTITION BY item, channel) AS m, stddev_samp(filled) OVER (PARTITION BY item, channel) AS s FROM filled)")
def f2_standardised(spark, sf_dir):
    return features.standardised(filled_panel(spark, sf_dir)).drop("y", "filled")


@query()
def f3_period_strengths(spark, sf_dir):
    return features.extract(filled_panel(spark, sf_dir), [lambda x: features.period_strengths(x, "H")])


@query(PANEL + ", b AS (SELECT item, channel, ntile(4) OVER (PARTITION BY item, channel ORDER BY t) AS k, filled, var_pop(filled) OVER (PARTITION BY item, channel) AS v FROM filled), c AS (SELECT item, channel, k, avg(filled) AS m, stddev_pop(filled) AS s, max(v) AS v FROM b GROUP BY 1, 2, 3) SELECT item, channel, " + r("least(1, var_pop(m) / max(v))") + " AS location, " + r("1 - exp(-var_pop(ln((s + 1e-12) / sqrt(v))))") + " AS scale FROM c GROUP BY 1, 2")
def f4_temporal_heterogeneity(spark, sf_dir):
    return features.temporal_heterogeneity(filled_panel(spark, sf_dir))


@query(PANEL + ", u AS (SELECT item, channel, avg(filled) AS m, var_pop(filled) AS v FROM filled GROUP BY 1, 2), o AS (SELECT quantile_cont(sqrt(v), 0.5) AS ref FROM u) SELECT " + r("var_pop(m) / (var_pop(m) + avg(v))") + " AS location, " + r("1 - exp(-var_pop(ln((sqrt(v) + 1e-12) / ref)))") + " AS scale FROM u, o")
def f5_spatial_heterogeneity(spark, sf_dir):
    return features.spatial_heterogeneity(filled_panel(spark, sf_dir))


@query()
def f6_frequency_heterogeneity(spark, sf_dir):
    return features.extract(filled_panel(spark, sf_dir), [lambda x: {"frequency": features.frequency_heterogeneity(x)}])


@query()
def f4_mean_heterogeneity(spark, sf_dir):
    return features.heterogeneity(filled_panel(spark, sf_dir))


@query()
def f7_decomposition_features(spark, sf_dir):
    return features.extract(filled_panel(spark, sf_dir), [lambda x: features.decomposition_features(x, [24])])


@query()
def f8_multiple_seasons(spark, sf_dir):
    return features.extract(filled_panel(spark, sf_dir), [lambda x: features.decomposition_features(x, [12, 24, 168])])


@query(PANEL + "SELECT item, channel FROM (SELECT DISTINCT item, channel FROM panel) WHERE NOT (channel = 0 AND item < 'f')")
def f10_missing_features(spark, sf_dir):
    p = hourly_panel(spark, sf_dir)
    done = p.where("channel = 0 and item < 'f'").select(*SERIES).distinct()
    return features.missing_only(p.select(*SERIES).distinct(), done)


@query(PANEL + ", m AS (SELECT item, channel, avg(y) AS mean, stddev_pop(y) AS std FROM panel GROUP BY 1, 2) SELECT 'mean' AS feature, " + r("avg(mean)") + " AS mean, count(mean) AS defined, count(*) AS series FROM m UNION ALL SELECT 'std', " + r("avg(std)") + ", count(std), count(*) FROM m")
def g31_feature_summary(spark, sf_dir):
    return features.summary(features.moments(hourly_panel(spark, sf_dir)), ["mean", "std"])
