"""Operators that SQL can't say, and edges of those it can, against plain NumPy."""

import json
import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import columns, vectors
from chronoloom.operators import audit, features, forecast, metrics, reports, retrieval, ridge, screening, series, windows
from chronoloom.sources import tables
from chronoloom.streaming import events as stream

PANEL = "item string, channel int, t long, y double"


def panel(spark, **values):
    return spark.createDataFrame([(i, 0, t, y) for i, v in values.items() for t, y in enumerate(v)], PANEL)


def test_frequencies():
    assert columns.parse_frequency("15T") == (15, "T") and columns.parse_frequency("W-SUN") == (1, "W") and columns.parse_frequency("30min") == (30, "T")
    assert [columns.seasonality(f) for f in ("H", "15T", "7H", "M", "B", "10S")] == [24, 96, 1, 12, 5, 360]
    assert columns.horizon_for("H", "long") == 720 and columns.horizon_for("M", m4=True) == 18 and columns.stride_for("Q-DEC") == 3
    with pytest.raises(ValueError, match="frequency"):
        columns.parse_frequency("-")


def test_ticks_and_times(spark):
    df = spark.sql("select timestamp_ntz'2024-03-01 05:30:00' as s, 3L as o")
    row = df.select(columns.tick(F.col("s"), "H", F.col("o")), columns.tick(F.col("s"), "M", F.col("o")), columns.tick(F.col("s"), "Q", F.col("o")), columns.position_time(F.col("s"), 3600, F.col("o")), columns.parse_time(F.lit("2024-03-01")), columns.parse_time(F.lit("no"))).first()
    assert row[0] == pd.Period("2024-03-01 05:30", "h").ordinal + 3 and row[1] == pd.Period("2024-03", "M").ordinal + 3 and row[2] == pd.Period("2024-03", "Q").ordinal + 3
    assert str(row[3]) == "2024-03-01 08:30:00" and row[4] is not None and row[5] is None


def test_business_day_ticks(spark):
    days = pd.bdate_range("2023-12-25", periods=30)
    df = spark.createDataFrame([(d.to_pydatetime(),) for d in days], "s timestamp_ntz")
    got = [r[0] for r in df.orderBy("s").select(columns.tick(F.col("s"), "B", F.lit(0).cast("long"))).collect()]
    assert [b - a for a, b in zip(got[:-1], got[1:], strict=True)] == [1] * 29


def test_filters_and_configs(spark):
    config = {"a": {"b": 2, "c": "x"}, "d": True}
    assert columns.flatten_config(config) == {"a.b": 2, "a.c": "x", "d": True}
    assert columns.config_hash(config) == columns.config_hash(dict(reversed(config.items())))
    df = spark.createDataFrame([(json.dumps(config),)], "c string")
    ok = lambda *f: df.select(columns.matches_filters(F.col("c"), columns.parse_filters(list(f)))).first()[0]
    assert ok("a.b=2", "a.c=x", "d=true") and not ok("a.b=3") and not ok("z=1")
    assert columns.context_limit(30, 24, 1000) == 48 and columns.context_limit(30, 24, 40) == 40


def test_masked_distances(spark):
    rng = np.random.default_rng(0)
    rows = [([None if rng.random() < 0.15 else float(x) for x in rng.normal(size=20)], [None if rng.random() < 0.15 else float(x) for x in rng.normal(size=20)]) for _ in range(40)] + [([None] * 20, [1.0] * 20)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select("a", "b", vectors.distance(F.col("a"), F.col("b")), vectors.distance(F.col("a"), F.col("b"), "cosine"), vectors.normalised(F.col("a"))).collect()
    for r in got:
        a, b = (np.array([np.nan if x is None else x for x in v]) for v in (r[0], r[1]))
        both = ~np.isnan(a) & ~np.isnan(b)
        if both.sum() < 16:
            assert r[2] is None and r[3] is None
            continue
        x, y = a[both], b[both]
        assert r[2] == pytest.approx(math.sqrt(((x - y) ** 2).sum() * 20 / both.sum()))
        assert r[3] == pytest.approx(1 - x @ y / math.sqrt((x @ x) * (y @ y)))
        z = (a - np.nanmean(a)) / np.nanstd(a)
        assert [v for v in r[4] if v is not None] == pytest.approx(z[~np.isnan(z)].tolist())


def test_series_without_values(spark):
    p = panel(spark, empty=[None] * 5, late=[None, None, 3.0, None, 5.0])
    filled = {r["item"]: [x.filled for x in sorted(series.forward_fill(p).where(F.col("item") == r["item"]).collect(), key=lambda x: x.t)] for r in p.select("item").distinct().collect()}
    assert filled == {"empty": [0.0] * 5, "late": [3.0, 3.0, 3.0, 3.0, 5.0]}
    line = [r.filled for r in series.interpolate(p).where("item = 'late'").orderBy("t").collect()]
    assert line == [3.0, 3.0, 3.0, 4.0, 5.0]
    scales = {r["item"]: r.mase_scale for r in series.seasonal_scales(p, 2).collect()}
    assert scales == {"empty": None, "late": 2.0}
    assert {r.acf1 for r in series.autocorrelation(series.forward_fill(p)).collect()} == {None}


def test_preparation_is_checked():
    good = {"test_length": 48, "horizon": 24, "context": 48, "period": 24, "fitting_stride": 23, "datastore_stride": 24}
    assert windows.Preparation(**good).windows == 2
    for bad in ({"test_length": 0}, {"test_length": 12}, {"datastore_stride": 25}, {"fitting_stride": 12}):
        with pytest.raises(ValueError):
            windows.Preparation(**(good | bad))


def test_window_checks(spark):
    s = spark.createDataFrame([("a", 100), ("b", 60)], "item string, length long")
    assert windows.check_lengths(s, 40, 10, 5) == ["test_length is over half of the shortest series"]
    with pytest.raises(ValueError, match="shortest"):
        windows.check_lengths(s, 40, 30, 5)
    refs = spark.createDataFrame([("a", 0, 1, 1)], "item string, channel int, origin long, tick long")
    with pytest.raises(ValueError, match="dates"):
        windows.require_dates(refs, 11)
    with pytest.raises(Exception, match="past its series"):
        windows.materialise(refs, spark.createDataFrame([("a", 0, [1.0])], "item string, channel int, values array<double>"), 1, 5).collect()


def test_shared_cap_that_leaves_nothing_is_an_error(spark):
    refs = spark.createDataFrame([(c, 0, o, o) for c in "abc" for o in range(3)], "item string, channel int, origin long, tick long")
    with pytest.raises(Exception, match="no window"):
        windows.recent_cap(refs, 2, True).collect()
    assert windows.recent_cap(refs, 100, True).count() == 9 and windows.recent_cap(refs, 6, True).count() == 6


def test_shared_cap_under_a_window_a_series_may_leave_nothing(spark):
    refs = spark.createDataFrame([(c, 0, o, o) for c in "abc" for o in range(3)], "item string, channel int, origin long, tick long")
    assert windows.recent_cap(refs, 2, True, needed=False).count() == 0
    assert windows.recent_cap(refs, 6, True, needed=False).count() == 6 and windows.recent_cap(refs, 100, True, needed=False).count() == 9


def test_metrics_refuse_missing_forecasts(spark):
    cells = spark.createDataFrame([("a", 0, 0, 0, 1.0, None, 1.0)], "item string, channel int, window int, h int, y double, yhat double, scale double")
    with pytest.raises(Exception, match="missing inside"):
        metrics.window_metrics(cells).collect()
    assert metrics.interval_levels(metrics.LEVELS) == [20, 40, 60, 80]


def test_undefined_metrics_are_null(spark):
    cells = spark.createDataFrame([("a", 0, 0, 0, 0.0, 0.0, None)], "item string, channel int, window int, h int, y double, yhat double, scale double")
    m = metrics.window_metrics(cells).first()
    assert (m.mse, m.smape, m.mape, m.mase, m.nd) == (0.0, 0.0, None, None, None)


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x, beta = rng.normal(size=(60, 4)), np.array([1.0, -2.0, 0.5, 0.0])
    y, s = x @ beta + rng.normal(size=60) * 0.1, rng.uniform(0.5, 2, 60)
    rows = [("g", int(i // 3), float(s[i]), float(y[i]), x[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, window int, scale double, residual double, x array<double>")
    st = ridge.statistics(df, ["g"], 4)
    one = ridge.solve(st, 4, 1e-2).withColumn("mse", ridge.mean_squared_error(4)).first()
    xs, ys = x / s[:, None], y / s
    want = ridge.solve_matrix(xs.T @ xs, xs.T @ ys, 60, 1e-2)
    assert one.beta == pytest.approx(want.tolist()) and one.mse == pytest.approx(float(((ys - xs @ want) ** 2).mean())) and one.windows == 20
    keep = ridge.feature_indices("targets", 1)
    assert [ridge.feature_names(1)[i] for i in keep] == ["V", "Y1"]
    sub = ridge.solve(ridge.select(st, 4, [0, 2]), 2, 1e-2).first()
    assert sub.beta == pytest.approx(ridge.solve_matrix(xs[:, [0, 2]].T @ xs[:, [0, 2]], xs[:, [0, 2]].T @ ys, 60, 1e-2).tolist())
    halves = ridge.statistics(df.withColumn("h", F.col("window") % 2), ["g", "h"], 4)
    assert ridge.merge(halves, ["g"], 4).first().xtx == pytest.approx(st.first().xtx)
    with pytest.raises(Exception, match="not finite"):
        ridge.statistics(df.withColumn("residual", F.lit(None).cast("double")), ["g"], 4).collect()
    assert np.isfinite(ridge.solve_matrix(np.zeros((2, 2)), np.zeros(2), 1, 0.0)).all()


def test_bootstrap_choice(spark):
    b = ridge.Bootstrap(replications=200, seed=5)
    assert ridge.block_length(27, 24, 23, b) == 3 and ridge.block_length(1, 24, 23, b) == 1 and ridge.block_length(3, 400, 1, b) == 2
    d = np.random.default_rng(1).normal(size=30)
    rng = np.random.default_rng(5)
    sums = np.zeros(200)
    for at in range(0, 30, 4):
        w = min(4, 30 - at)
        sums += np.array([d[k : k + w].sum() for k in rng.integers(0, 27, size=200)])
    assert ridge.standard_error(d, 4, b) == pytest.approx(np.std(sums / 30, ddof=1))
    rows = [("t", m, k, 0.01, tick, loss(tick)) for m, k, loss in (("vanilla", 0, lambda t: 1.0 + 0.001 * (t % 2)), ("ridge", 5, lambda t: 1.0), ("bad", 1, lambda t: 3.0)) for tick in range(20)]
    got = {r.method: r for r in ridge.choose(spark.createDataFrame(rows, "task string, method string, k int, alpha double, tick long, loss double"), ["task"], 24, 23, b).collect()}
    assert got["ridge"].selected != got["vanilla"].selected and not got["bad"].selected and got["ridge"].difference == 0


def test_neighbours_are_required(spark):
    q = spark.createDataFrame([("q", "a", 0, 10, [1.0])], "ref_id string, item string, channel int, tick long, rep array<double>")
    d = spark.createDataFrame([(f"d{i}", "a", 0, i, [float(i)]) for i in range(10)], "ref_id string, item string, channel int, tick long, rep array<double>")
    pairs = retrieval.eligible(q, d, 2, 3)
    assert sorted(r.ref_id for r in pairs.collect()) == ["d0", "d2", "d4", "d6"]
    near = retrieval.nearest(pairs, 2)
    assert [r.ref_id for r in near.orderBy("rank").collect()] == ["d0", "d2"]
    with pytest.raises(ValueError, match="neighbours"):
        retrieval.require_neighbours(near, q, 5)
    with pytest.raises(Exception, match="no value"):
        retrieval.gather(near, d.where("ref_id <> 'd0'").withColumn("v", F.lit(1.0)), "v", 2).collect()
    with pytest.raises(ValueError, match="scope"):
        retrieval.eligible(q, d, 2, 3, "none")


def test_screening_reasons(spark):
    rng = np.random.default_rng(4)
    t = np.arange(300)
    p = panel(spark, good=(np.sin(t / 5) + rng.normal(size=300) * 0.1).tolist(), noise=rng.normal(size=300).tolist(), flat=[1.0] * 300, gaps=[None if i % 3 else float(i) for i in t], short=[1.0, 2.0])
    got = {r["item"]: r.checks for r in screening.screen(p, 100, 30).collect()}
    assert got == {"good": [], "noise": ["white_noise"], "flat": ["constant"], "gaps": ["missing"], "short": ["length"]}
    assert screening.chi2_tail(18.307, 10) == pytest.approx(0.05, abs=1e-4) and screening.chi2_tail(31.41, 20) == pytest.approx(0.05, abs=1e-4)


def test_outliers_are_cleaned(spark):
    values = [float(i % 7) for i in range(200)]
    values[50] = 1000.0
    values[90] = None
    p = series.forward_fill(panel(spark, a=values))
    out = [r.cleaned for r in screening.clean_outliers(p, 20).orderBy("t").collect()]
    assert out[50] == values[49] and out[90] is None and out[51] == values[51]


def test_spectra_and_decomposition():
    t = np.arange(720)
    x = np.sin(2 * np.pi * t / 24) * 3 + t * 0.01 + np.random.default_rng(2).normal(size=720) * 0.2
    top = features.period_strengths(x, "H")
    assert top["period1"] == 24 and top["strength1"] > 0.1
    f = features.decomposition_features(x, [24])
    assert f["seasonal_strength"] > 0.95 and f["trend_strength"] > 0.9 and f["seasonal_corr"] > 0.99 and 0.98 < f["e_shapiro_w"] <= 1 and f["stationarity"] == 1.0
    walk = np.cumsum(np.random.default_rng(3).normal(size=800))
    assert features.stationary(walk) == 0 and features.hurst(walk) > 0.8
    assert features.divergence(np.array([[1.0, 0.0], [0.0, 1.0]])) == pytest.approx(0.311278, abs=1e-5)
    assert features.frequency_heterogeneity(np.ones(64)) == 0.0 and features.spectrum(np.ones(9))[0] == 1.0
    assert set(features.decomposition_features(np.ones(40), [7])) == set(f)


def test_loess_and_decomposition_match_plain_ones():
    rng = np.random.default_rng(12)
    y = rng.normal(size=40).cumsum()

    def plain(at, width, n):
        q = min(width, n)
        left = min(max(0, at - (q - 1) // 2), n - q)
        reach = max(at - left, left + q - 1 - at) + max(0, width - n) // 2
        w = np.zeros(n)
        for j in range(left, left + q):
            w[j] = (1 - (abs(j - at) / reach) ** 3) ** 3 if abs(j - at) <= 0.999 * reach else 0.0
        a = np.column_stack([np.ones(n), np.arange(n) - at])
        return np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0]

    for width in (7, 13, 39, 51):
        assert features.loess(y, width) == pytest.approx([plain(i, width, 40) for i in range(40)])
        assert features.loess(y, width, ends=True)[[0, -1]] == pytest.approx([plain(-1, width, 40), plain(40, width, 40)])
    t = np.arange(24 * 30)
    day, half, line = np.sin(2 * np.pi * t / 24), 0.5 * np.cos(2 * np.pi * t / 7), 0.01 * t
    trend, seasons, e = features.decompose(day + line, [24])
    assert np.abs(seasons[24] - day).max() < 0.02 and np.abs(trend - line).max() < 0.02 and np.abs(e).max() < 0.02
    trend, seasons, e = features.decompose(day + half + line, [7, 24])
    assert np.abs(seasons[24] - day).max() < 0.1 and np.abs(seasons[7] - half).max() < 0.1
    assert trend + seasons[24] + seasons[7] + e == pytest.approx(day + half + line)
    assert features.decompose(y[:5], [7])[1] == {}


def test_heterogeneity_with_uneven_blocks(spark):
    x = np.random.default_rng(6).normal(size=35).cumsum()
    got = features.temporal_heterogeneity(series.forward_fill(panel(spark, a=x.tolist(), tiny=[1.0, 2.0]))).collect()
    by = {r["item"]: r for r in got}
    blocks = np.array_split(x, 4)
    assert by["a"].location == pytest.approx(np.var([b.mean() for b in blocks]) / x.var())
    assert by["a"]["scale"] == pytest.approx(1 - math.exp(-np.var(np.log([b.std() / x.std() for b in blocks]))))
    assert (by["tiny"].location, by["tiny"]["scale"]) == (0.0, 0.0)


def test_forecasters(spark):
    rows = spark.createDataFrame([(1, [1.0, None, 3.0, 4.0]), (2, [5.0, 6.0]), (3, [None, None])], "id long, context array<double>")
    got = {r.id: r.yhat for r in forecast.forecast(rows, lambda: forecast.SeasonalNaive(2), 3, ["id"]).collect()}
    assert got == {1: [3.0, 4.0, 3.0], 2: [5.0, 6.0, 5.0], 3: [0.0, 0.0, 0.0]}
    near = rows.withColumn("near", F.when(F.col("id") == 2, F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(3.0), F.lit(5.0)))))
    got = {r.id: r.yhat for r in forecast.forecast(near, lambda: forecast.RetrievalMean(2), 2, ["id"], "near").collect()}
    assert got[2] == [2.0, 4.0] and got[1] == [3.0, 4.0]
    made = forecast.rollout(np.array([[1.0, 2.0]]), lambda c, n: np.repeat(c[:, -1:] + 1, n, axis=1), 5, 2)
    assert made.tolist() == [[3.0, 3.0, 4.0, 4.0, 5.0]]
    results = forecast.isolated(["a", "b"], lambda t: 1 / (t == "a"), lambda t: "vanilla")
    assert results["a"][0] == "ok" and results["b"][:2] == ("fallback", "vanilla")


def test_a_baseline_is_its_own_equal(spark):
    r = spark.createDataFrame([("d", t, m, v) for t, b in (("t", 4.0), ("u", 8.0)) for m, v in (("m", 2.0), ("base", b))], "dataset string, term string, method string, mase double")
    # Sums in another order: a value that is drawn anew wherever it is worked out.
    noisy = r.withColumn("mase", F.col("mase") * (1 + F.rand() * 1e-12))
    keys, low = ["dataset", "term"], F.col("method") == "base"
    assert {x.scaled for x in reports.scaled_within(noisy, low, keys).where(low).collect()} == {1.0}
    assert sorted(x.scaled for x in reports.scaled_within(r, low, keys).collect()) == [0.25, 0.5, 1.0, 1.0]
    with pytest.raises(Exception, match="baseline"):
        reports.scaled_within(r.where("method = 'm'"), low, keys).collect()
    with pytest.raises(Exception, match="several rows"):
        reports.scaled_within(r.unionAll(r), low, keys).collect()


def test_reports(spark):
    r = spark.createDataFrame([("d", "t", "m", 2.0), ("d", "t", "base", 4.0)], "dataset string, term string, method string, mase double")
    base = r.where("method = 'base'")
    assert {x.scaled for x in reports.scaled_error(r, base, ["dataset", "term"]).collect()} == {0.5, 1.0}
    with pytest.raises(Exception, match="baseline"):
        reports.scaled_error(r, base.where("1 = 0"), ["dataset", "term"]).collect()
    with pytest.raises(Exception, match="several rows"):
        reports.scaled_error(r, base.unionAll(base), ["dataset", "term"]).collect()
    assert r.select(reports.geometric_mean(F.col("mase")), reports.geometric_mean(F.col("mase") * 0)).first() == (pytest.approx(math.sqrt(8)), 0.0)
    runs = spark.createDataFrame([("i", c, n, n, "completed", c == 1 and n == 0) for c in (1, 2) for n in range(3)] + [("i", 1, 9, 9, "running", False)], "identity string, config int, run int, stamp int, status string, selected boolean")
    with pytest.raises(ValueError, match="several configurations"):
        reports.select_runs(runs)
    assert sorted((x.config, x.run) for x in reports.select_runs(runs, "distinct").collect()) == [(1, 0), (2, 2)]
    assert reports.select_runs(runs, "average", "average").count() == 6
    assert reports.trend_svg([(0.0, 1.0), (1.0, 2.0)], 1.0, 1.0, "a<b").count("<circle") == 2


def test_spearman_with_ties_matches_pandas(spark):
    rng = np.random.default_rng(8)
    df = pd.DataFrame({"feature": "f", "model": np.repeat(["a", "b"], 20), "x": rng.integers(0, 5, 40).astype(float), "y": rng.normal(size=40)})
    got = {r.model: r.rho for r in reports.spearman(spark.createDataFrame(df)).collect()}
    for m, g in df.groupby("model"):
        assert got[m] == pytest.approx(g.x.rank().corr(g.y.rank()))


def test_audit_of_infinities(spark):
    p = panel(spark, a=[1.0, 1.0, float("inf"), -float("inf"), float("nan"), None, 2.0, 2.0])
    w = spark.createDataFrame([("a", 0, 0, 2), ("a", 1, 2, 6), ("a", 2, 5, 8)], "item string, window int, start int, stop int")
    got = {r.window: r for r in audit.interval_counts(p, w, ["window"]).collect()}
    assert got[0].constant_windows == 1 and got[1].all_nonfinite_windows == 1 and (got[1].posinf_count, got[1].neginf_count, got[1].nan_count) == (1, 1, 2)
    assert got[2].nonfinite_windows == 1 and got[2].constant_windows == 0
    last = series.audit_counters(p).where("t = 7").first()
    assert (last.nan_upto, last.posinf_upto, last.neginf_upto) == (2, 1, 1)


def test_files_to_items_and_back(spark, tmp_path):
    for name in ("one", "two"):
        pd.DataFrame({"date": pd.date_range("2024-01-01", periods=4, freq="D"), "a": [1.0, 2, None, 4], "b": [5.0, 6, 7, 8]}).iloc[::-1].to_csv(tmp_path / f"{name}.csv", index=False)
    long = tables.scan_csv(spark, f"{tmp_path}/*.csv")
    items = tables.items(long, "D")
    assert sorted(r.item_id for r in items.collect()) == ["one", "two"] and items.first().target == [[1.0, 2.0, None, 4.0], [5.0, 6.0, 7.0, 8.0]]
    tables.write_stage(items, f"{tmp_path}/stage")
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_stage(items, f"{tmp_path}/stage")
    back = tables.panel_of(spark.read.parquet(f"{tmp_path}/stage"))
    assert back.count() == 16 and {r.name for r in back.collect()} == {"a", "b"}
    assert sorted(r.item_id for r in tables.items(long, "D", True).collect()) == ["one_a", "one_b", "two_a", "two_b"]
    with pytest.raises(Exception, match="(?i)path"):
        tables.scan_csv(spark, f"{tmp_path}/none/*.csv")
    tables.write_report(back.groupBy("item").count(), f"{tmp_path}/report")
    assert spark.read.csv(f"{tmp_path}/report", header=True).count() == 2


def test_task_catalog(tmp_path):
    text = "datasets:\n  Wind_Power/H:\n    test_length: 96\n    terms: {short: {prediction_length: 24}, long: {prediction_length: 48}}\n  Sales/D:\n    test_length: 30\n    val_length: 10\n    terms: {short: {prediction_length: 7}}\n"
    (tmp_path / "tasks.yaml").write_text(text)
    tasks = tables.load_tasks(str(tmp_path / "tasks.yaml"))
    assert len(tasks) == 3 and tasks[2]["val_length"] == 10 and tasks[0]["freq"] == "H"
    assert tables.find_dataset(tasks, "wind power") == "Wind_Power"
    with pytest.raises(ValueError, match="0 datasets"):
        tables.find_dataset(tasks, "x")
    assert len(tables.select_tasks(tasks, exclude=["Sales"], terms=["short"])) == 1
    for bad in ({"exclude": ["No"]}, {"include": []}):
        with pytest.raises(ValueError):
            tables.select_tasks(tasks, **bad)
    assert tables.resolve("h", None, {"h": None}, {"h": 3}) == 3
    assert tables.target_mode("auto", 3, True) == "multivariate" and tables.target_mode("auto", 3, False) == "univariate" and tables.covariate_field("none") is None
    assert tables.Roots("/x").path("logs") == "/x/logs"


def test_settings_come_from_the_first_level_that_has_them():
    config = {
        "datasets": {"Power/H": {"test_length": 96, "terms": {"short": {"horizon": 24}, "long": {"horizon": 96}}}},
        "tasks": {"Power/H": {"stride": 24, "context": 48, "ranges": {"long": {"context": 192}}}},
        "defaults": {"H": {"fitting_stride": 127, "stride": 1}},
    }
    names = ["horizon", "stride", "context", "fitting_stride", "test_length"]
    assert tables.protocol(config, "Power/H", "short", names) == {"horizon": 24, "stride": 24, "context": 48, "fitting_stride": 127, "test_length": 96}
    assert tables.protocol(config, "Power/H", "long", names, {"stride": 48}) == {"horizon": 96, "stride": 48, "context": 192, "fitting_stride": 127, "test_length": 96}
    with pytest.raises(ValueError, match="cap"):
        tables.protocol(config, "Power/H", "short", ["cap"])
    with pytest.raises(ValueError, match="positive"):
        tables.protocol(config, "Power/H", "short", ["stride"], {"stride": 0})


def test_average_policies_average(spark):
    rows = [("a", 1, r, r, "completed", False, float(r)) for r in range(3)] + [("a", 2, 9, 9, "completed", True, 7.0), ("b", 1, 4, 4, "running", False, 100.0)]
    runs = spark.createDataFrame(rows, "identity string, config int, run int, stamp int, status string, selected boolean, mase double")
    assert [tuple(r) for r in reports.select_runs(runs, "average", "average", values=["mase"]).collect()] == [("a", 4.0)]
    assert sorted((r.config, r.mase) for r in reports.select_runs(runs, "distinct", "average", values=["mase"]).collect()) == [(1, 1.0), (2, 7.0)]
    assert reports.exactly_one(runs, runs.run == 9)["mase"] == 7.0
    for condition in (runs.run == 77, runs.config == 1):
        with pytest.raises(ValueError, match="row"):
            reports.exactly_one(runs, condition)


def test_run_lifecycle(tmp_path):
    runs = tables.Runs(str(tmp_path))
    path, what = runs.allocate({"m": 1}, {"k": 2})
    assert what == "new" and runs.allocate({"m": 1}, {"k": 2}, "resume") == (path, "resume")
    with pytest.raises(ValueError, match="missing"):
        runs.complete(path, ["out.txt"])
    (tmp_path / path / "out.txt").write_text("x")
    runs.complete(path, ["out.txt"])
    assert runs.allocate({"m": 1}, {"k": 2}, "skip") == (path, "skip")
    other, what = runs.allocate({"m": 1}, {"k": 2})
    assert what == "new" and other.endswith("run_1")


def test_streams(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 0, 10), "a", 1.0), (1, datetime(2024, 1, 1, 0, 50), "a", None), (2, datetime(2024, 1, 1, 5), "b", 2.0)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/in")
    source = stream.read(spark, f"{tmp_path}/in", "user_id long, ts timestamp, event_type string, value double")
    stream.run_once(stream.tumbling_audit(source, lateness="10 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.event_type, r.events, r.missing) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert ("a", 2, 1) in got
    stream.upsert_cache(stream.read(spark, f"{tmp_path}/in", "user_id long, ts timestamp, event_type string, value double"), f"{tmp_path}/cache", ["user_id"], f"{tmp_path}/cp2")
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 2
    assert stream.sessions(spark.read.parquet(f"{tmp_path}/in")).count() == 3


@pytest.mark.parametrize("by_variate", [False, True])
def test_family_prefers_what_fits(spark, by_variate):
    rng = np.random.default_rng(11)
    rows = []
    for item in "ab":
        for window in range(12):
            for h in range(6):
                vanilla, covariate, near = (float(x) for x in rng.normal(size=3))
                y = vanilla + 0.8 * near + 0.01 * float(rng.normal())
                rows.append(("t", item, 0, window, window, h, 1.0, y, y - vanilla, vanilla, covariate, [near] if window != 11 else [], [0.0] if window != 11 else []))
    df = spark.createDataFrame(rows, "task string, item string, channel int, window int, tick long, h int, scale double, y double, residual double, vanilla double, covariate double, neighbours array<double>, own array<double>")
    got = ridge.fit_family(df.where("window < 6"), df.where("window >= 6"), ["task"], 6, 6, ks=(1,), alphas=(1e-3,), by_variate=by_variate, b=ridge.Bootstrap(replications=50)).collect()
    by = {r.method: r for r in got}
    assert set(by) == {"vanilla", "bayes", "covariate_ridge", "targets_ridge", "full_ridge"}
    assert by["targets_ridge"].mean_loss < 0.5 * by["vanilla"].mean_loss and sum(r.selected for r in got) == 1


def test_command_line_lists_queries(capsys, monkeypatch):
    from chronoloom import __main__

    monkeypatch.setattr("sys.argv", ["chronoloom", "list"])
    __main__.main()
    assert "g1_window_metrics" in capsys.readouterr().out


@pytest.mark.parametrize("within", [True, False])
def test_correlated_pairs_in_blocks_are_those_of_the_join(spark, monkeypatch, within):
    monkeypatch.setattr(screening, "BLOCK", 4)
    rng = np.random.default_rng(8)
    base = rng.normal(size=30)
    rows = []
    for i in range(5):
        for c in range(4):
            y = [None if rng.random() < 0.3 else float(v) for v in 1e6 + base * (c - 1) + rng.normal(size=30)]
            if (i, c) == (1, 2):
                y = [7.1] * 30  # no variation
            if (i, c) == (2, 0):
                y = [None] * 28 + [1.0, 2.0]
            if (i, c) == (3, 3):
                y[4] = float("nan")
            if (i, c) == (3, 1):
                y = [0.1] * 15 + [None] * 14 + [5.0]
            rows += [(f"i{i}", c, t, v) for t, v in enumerate(y if i < 4 else y[:20])]
    p = spark.createDataFrame(rows, PANEL)
    q = p.select("t", "y", F.concat_ws("/", "item", F.col("channel").cast("string")).alias("name"), F.when(F.lit(within), F.col("item")).otherwise(F.when(F.col("item") < "i4", "30").otherwise("20")).alias("g")).where("y is not null")
    pairs = q.alias("a").join(q.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.name") < F.col("b.name")))
    r = pairs.groupBy(F.col("a.name").alias("a"), F.col("b.name").alias("b")).agg(reports.correlation("a.y", "b.y").alias("r")).where(F.abs("r") > 0.2)
    want = {(x.a, x.b): x.r for x in r.collect()}
    frame = screening.correlated_pairs(p, within, 0.2)
    got = {(x.a, x.b): x.r for x in frame.collect()}
    assert set(got) == set(want) and frame.count() == len(want) > 10
    assert all(got[k] == pytest.approx(want[k], abs=1e-9, nan_ok=True) for k in want) and any(math.isnan(v) for v in got.values())
    assert "FlatMapGroupsInArrow" in frame._jdf.queryExecution().optimizedPlan().toString()


def test_correlated_pairs_of_few_steps(spark):
    assert screening.correlated_pairs(panel(spark, a=[1.0], b=[2.0], c=[None]), False, 0.0).count() == 0
    assert screening.correlated_pairs(panel(spark, a=[1.0, 2.0]), False, 0.0).count() == 0
    assert [tuple(x) for x in screening.correlated_pairs(panel(spark, b=[1.0, 2.0], a=[4.0, 3.0]), False, 0.5).collect()] == [("a/0", "b/0", pytest.approx(-1.0))]
