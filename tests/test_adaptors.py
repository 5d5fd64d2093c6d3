"""Neighbours, extraction and the family of adaptors against plain versions."""

import math
import os
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import vectors
from chronoloom.operators import evaluation, extraction, family, forecast, metrics, retrieval, ridge, series
from chronoloom.plans import catalog, series_queries
from chronoloom.sources import stages

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def refs(rng, n, width=12, step=3):
    """References of three series, some values missing and some vectors equal."""
    rows = []
    for i in range(n):
        rep = [None if rng.random() < 0.12 else float(x) for x in rng.normal(size=width)]
        if i % 9 == 4:
            rep = list(rows[-1][4])
        rows.append((f"r{i:03d}", "ab"[i % 2], i % 3 % 2, int(rng.integers(0, 60)) * step, rep))
    return rows


SCHEMA = "ref_id string, item string, channel int, tick long, rep array<double>"


@pytest.mark.parametrize("scope", retrieval.SCOPES)
@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_blocks_find_the_neighbours_that_pairs_do(spark, monkeypatch, scope, metric):
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    monkeypatch.setattr(retrieval, "BATCH", 7)
    rng = np.random.default_rng(3)
    asked, store = spark.createDataFrame(refs(rng, 60), SCHEMA).withColumn("ref_id", F.concat(F.lit("q"), "ref_id")), spark.createDataFrame(refs(rng, 300), SCHEMA)
    want = {(r.query_id, r["rank"]): (r.ref_id, r.distance) for r in retrieval.nearest(retrieval.eligible(asked, store, 12, 6, scope), 4, metric).collect()}
    got = {(r.query_id, r["rank"]): (r.ref_id, r.distance) for r in retrieval.nearest_blocks(asked, store, 12, 6, 4, scope, metric).collect()}
    assert set(got) == set(want) and len(want) > 40
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    assert retrieval.nearest_blocks(asked, store.limit(0), 12, 6, 4, scope, metric).count() == 0


@pytest.mark.parametrize("scope", retrieval.SCOPES)
def test_blocks_have_the_distances_of_all_pairs(spark, monkeypatch, scope):
    monkeypatch.setattr(retrieval, "PAIRS", (16, 7))
    rng = np.random.default_rng(5)
    asked, store = spark.createDataFrame(refs(rng, 60), SCHEMA).withColumn("ref_id", F.concat(F.lit("q"), "ref_id")), spark.createDataFrame(refs(rng, 300), SCHEMA)
    made = retrieval.eligible(asked, store, 12, 6, scope)
    want = {(r.query_id, r.ref_id): (r.e, r.c) for r in made.select("query_id", "ref_id", *[vectors.distance(F.col("q_rep"), F.col("d_rep"), m).alias(m[0]) for m in ("euclidean", "cosine")]).collect()}
    frame = retrieval.pair_distances(asked, store, 12, 6, ("euclidean", "cosine"), scope)
    got = {(r.query_id, r.ref_id): (r.euclidean, r.cosine) for r in frame.collect()}
    assert set(got) == set(want) and frame.count() == len(want) and {x is None for x, _ in want.values()} == {True, False}
    for k, pair in want.items():
        assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-12)) for a, b in zip(got[k], pair, strict=True))
    assert retrieval.pair_distances(asked, store.limit(0), 12, 6).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_blocks_count_candidates_as_pairs_do(spark, monkeypatch, metric):
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    monkeypatch.setattr(retrieval, "BATCH", 7)
    rng = np.random.default_rng(6)
    rows = refs(rng, 60)
    rows[0] = (*rows[0][:4], [0.0] * len(rows[0][4]))
    asked, store = spark.createDataFrame(rows, SCHEMA).withColumn("ref_id", F.concat(F.lit("q"), "ref_id")), spark.createDataFrame(refs(rng, 300), SCHEMA)
    pairs = retrieval.eligible(asked, store, 12, 6).select("query_id", vectors.distance(F.col("q_rep"), F.col("d_rep"), metric).alias("x"))
    want = {r.query_id: (r.n, r.m) for r in pairs.groupBy("query_id").agg(F.count("*").alias("n"), F.count("x").alias("m")).collect()}
    frame = retrieval.coverage(asked, store, 12, 6, metric=metric)
    got = {r.query_id: (r.eligible, r.comparable) for r in frame.collect()}
    assert len(got) == frame.count() == 60 and got == {f"q{r[0]}": want.get(f"q{r[0]}", (0, 0)) for r in rows}
    assert any(n > m > 0 for n, m in got.values()) and (0, 0) in got.values()
    assert {(r.eligible, r.comparable) for r in retrieval.coverage(asked, store.limit(0), 12, 6).collect()} == {(0, 0)}


def extracted(rng, windows=40, h=6, most=2):
    """Rows as extraction gives them; the target follows the first neighbour's future."""
    rows = []
    for split, n in (("train", windows), ("validation", windows // 2), ("test", 5)):
        for i in range(n):
            for item in "ab":
                vanilla, context, past = (rng.normal(size=h) for _ in range(3))
                near, own = rng.normal(size=(most, h)), rng.normal(size=(most, h))
                target = vanilla + 0.8 * near[0] - 0.3 * own[0] + 0.01 * rng.normal(size=h)
                lists = [near.tolist(), own.tolist()] if i % 8 != 3 else [[], []]
                if i % 11 == 5:
                    target[2] = np.nan
                scale = None if i % 13 == 7 else float(1 + i % 3)
                y = [None if np.isnan(x) else float(x) for x in target]
                rows.append(("t", item, 0, f"{split}{item}{i}", split, i, scale, y, vanilla.tolist(), past.tolist(), *lists, context.tolist() if lists[0] else None, context.tolist() if lists[0] else None))
    return rows


ROWS = "task string, item string, channel int, ref_id string, split string, tick long, scale double, target array<double>, vanilla array<double>, past array<double>, neighbours array<array<double>>, own array<array<double>>, context_1 array<double>, context_2 array<double>"


def test_the_family_matches_plain_numpy(spark):
    rng = np.random.default_rng(5)
    rows = extracted(rng)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    usable = [r for r in rows if r[10] and None not in r[7] and r[6] is not None]

    cover = {(r.split, r.k): r for r in extraction.coverage(df, ["split"], (1, 2)).collect()}
    train = [r for r in usable if r[4] == "train"]
    assert cover["train", 1].adapted_windows == len(train) and cover["train", 2].total_windows == 80
    labelled = [r for r in rows if r[4] == "train" and None not in r[7] and r[6] is not None]
    assert cover["train", 1].label_complete_windows == len(labelled) and cover["train", 1].vanilla_fallback_windows == len(labelled) - len(train)

    shared, single = family.members(df, (1, 2), (1e-2,))
    betas = {(r.method, r.k): r for r in shared.collect()}
    for k in (1, 2):
        x = np.vstack([np.column_stack([r[8], r[12], *r[10][:k], *r[11][:k]]) / r[6] for r in train])
        y = np.concatenate([(np.array(r[7]) - np.array(r[8])) / r[6] for r in train])
        for kind in family.KINDS:
            at = ridge.feature_indices(kind, k)
            want = np.zeros(2 + 2 * k)
            want[at] = ridge.solve_matrix(x[:, at].T @ x[:, at], x[:, at].T @ y, len(y), 1e-2)
            assert betas[f"{kind}_ridge", k].beta == pytest.approx(want.tolist(), abs=1e-9)
    loss = lambda r, f: float(np.mean(((np.array(r[7]) - np.array(f)) / r[6]) ** 2))
    won = sum(loss(r, r[12]) < loss(r, r[8]) for r in train)
    assert betas["bayes_covariate", 1].p == pytest.approx((1 + won) / (2 + len(train)))
    assert {(r["item"], r.k) for r in single.collect()} == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}

    made = family.forecasts(df.where("split = 'validation'"), shared, single, (1, 2)).collect()
    assert len(made) == 40 * (1 + 1 + 2 + 6 + 2)
    for r in made:
        row = next(x for x in rows if x[3] == r.ref_id)
        if r.method == "full_ridge":
            can = row in usable
            x = np.column_stack([row[8], row[12], *row[10][: r.k], *row[11][: r.k]]) if can else None
            want = np.array(row[8]) + (x @ np.array(betas["full_ridge", r.k].beta) if can else 0)
            assert r.yhat == pytest.approx(want.tolist()) and r.fallback == (not can)
    _, _, families, overall = family.fit(df, 6, 6, (1, 2), (1e-2,), ridge.Bootstrap(replications=50))
    families = families.collect()
    assert {r.family for r in families} == {"bayes_covariate", "bayes_past_targets", "covariate_ridge", "targets_ridge", "full_ridge", "per_variate_full_ridge"}
    for name in {r.family for r in families}:
        assert sum(r.selected for r in families if r.family == name) == 1
    chosen = [r.method for r in overall.collect() if r.selected]
    assert chosen in (["full_ridge"], ["per_variate_full_ridge"])
    shared, single = family.members(df, (1, 2), (1e-2,), train_ratio=100.0)
    assert {r.method for r in shared.collect()} == {"bayes_past_targets"} and single.count() == 0


def test_extraction_gives_neighbours_in_order_and_reasons(spark):
    rng = np.random.default_rng(6)

    def reference(i, split, tick, whole=True):
        context = [float(x) for x in rng.normal(size=8)]
        target = [float(x) for x in rng.normal(size=4)]
        if not whole:
            target[1] = None
        return (f"{split[0]}{i}", "a", i % 2, split, tick, 1.0, context, target, [float((x - np.mean(context)) / np.std(context)) for x in context])

    rows = [reference(i, "datastore", i % 10 * 4) for i in range(40)] + [reference(i, "test", 60 + 4 * (i // 2), i != 3) for i in range(8)] + [reference(9, "test", 2)]
    df = spark.createDataFrame(rows, "ref_id string, item string, channel int, split string, tick long, scale double, context array<double>, target array<double>, rep array<double>")
    got = {r.ref_id: r for r in extraction.extract(df.where("split = 'test'"), df.where("split = 'datastore'"), lambda: forecast.SeasonalNaive(4), lambda: forecast.RetrievalMean(4), 4, 4, (1, 3)).collect()}
    by = {r[0]: r for r in rows}
    store = [r for r in rows if r[3] == "datastore"]
    for i in range(8):
        q = by[f"t{i}"]
        near = sorted(((math.dist(q[8], d[8]), d[0]) for d in store if (q[4] - d[4]) % 4 == 0 and d[4] + 4 <= q[4]))[:3]
        r = got[q[0]]
        assert r.neighbour_ids == [n for _, n in near] and r.neighbours == [by[n][7] for _, n in near]
        assert r.own == [by[n][6][-4:] for _, n in near] and r.vanilla == q[6][-4:]
        assert r.context_3 == pytest.approx(np.mean([by[n][7] for _, n in near], axis=0).tolist()) and r.context_1 == by[near[0][1]][7]
        assert r.reason == (2 if i == 3 else 0)
        other = by[f"t{i ^ 1}"]
        scaled = (np.array(other[6][-4:]) - np.mean(other[6])) / np.std(other[6]) * np.std(q[6]) + np.mean(q[6])
        assert r.past == pytest.approx(scaled.tolist())
    assert got["t9"].reason == 1 and got["t9"].past is None and got["t9"].context_1 is None


def test_evaluation_counts_what_falls_back(spark):
    rows = [("a", 0, k, [1.0, None, 3.0], [1.0, 2.0, 3.0 + k] if k else [1.0, float("nan"), 3.0], [2.0, 2.0, 2.0], 2.0) for k in range(4)]
    cells, summary = evaluation.evaluate_points(spark.createDataFrame(rows, "item string, channel int, window int, target array<double>, yhat array<double>, vanilla array<double>, scale double"))
    got = {r.window: r for r in cells.collect()}
    assert got[0].fallback and got[0].mae == 1.0 and not got[2].fallback and got[2].mae == 1.0 and got[2].mase == 0.5
    total = {r.metric: r for r in summary.collect()}
    assert set(total) == set(evaluation.METRICS) and total["mae"].fallback == 1 and total["mae"].fallback_rate == 0.25


@pytest.mark.parametrize("step,horizon", [(5, 6), (7, 3)])
def test_strided_cells_are_those_of_the_joins(spark, step, horizon):
    rng = np.random.default_rng(4)
    rows = [(i, c, t, None if rng.random() < 0.2 or (i, c) == ("b", 1) and t < 20 else float(rng.integers(0, 9))) for i in "ab" for c in (0, 1) for t in range(60)]
    p = spark.createDataFrame(rows, "item string, channel int, t long, y double")
    made = metrics.strided_cells(p, 6, horizon, 14, step, 8, 13)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.item, r.channel, r.window, r.h): (r.origin, r.y, r.yhat, r.other, r.scale) for r in made.collect()}
    wins = spark.createDataFrame([(i, k, 14 + step * k) for i in "ab" for k in range(8)], "item string, window int, origin long")
    filled = series.forward_fill(p)
    cells = metrics.seasonal_naive(filled, wins, 6, horizon).join(metrics.actuals(p, wins, horizon).drop("origin"), [*metrics.WINDOW, "h"])
    cells = cells.join(series.prefix_scales(p, 6).select("item", "channel", "origin", "mase_scale"), ["item", "channel", "origin"])
    cells = cells.join(filled.select("item", "channel", (F.col("t") + 13).alias("at"), F.col("filled").alias("other")), ["item", "channel"]).where("at = origin + h")
    want = {(r.item, r.channel, r.window, r.h): (r.origin, r.y, r.yhat, r.other, r.mase_scale) for r in cells.collect()}
    assert set(got) == set(want) and len(want) == 4 * sum(1 for k in range(8) for h in range(horizon) if 14 + step * k + h < 60)
    assert all(a == b if a is None or b is None else a == pytest.approx(b) for k in want for a, b in zip(got[k], want[k], strict=True))
    assert any(v[1] is None for v in got.values()) and any(v[4] is None for v in got.values())
    with pytest.raises(ValueError, match="season"):
        metrics.strided_cells(p, 6, 7, 14, step, 8, 13)


@pytest.mark.skipif(not Path(DATA).exists(), reason="the generated tables are not here")
def test_the_long_design_is_never_broadcast(spark):
    plans = [catalog.queries()[q](spark, DATA)._jdf.queryExecution().optimizedPlan().toString() for q in ("w17_sliding_statistics", "g16_horizon_ridge")]
    assert "Join" not in plans[0] and plans[1].count("Join") == plans[1].count("Join LeftSemi") == 1


def test_the_panel_is_made_without_a_join(spark, tmp_path):
    db, path = duckdb.connect(), f"{tmp_path}/events.parquet"
    rows = "(0, 1, 'view', 1.25), (0, 2, 'view', 2.5), (719, 1, 'view', -3.0), (5, 151, 'view', NULL), (5, 1, 'click', NULL), (5, 2, 'click', 4.0), (6, NULL, 'click', 7.0), (7, 1, NULL, 8.0)"
    db.execute(f"COPY (SELECT TIMESTAMP '2024-01-01' + to_hours(h) AS ts, CAST(u AS BIGINT) AS user_id, k AS event_type, CAST(v AS DOUBLE) AS value FROM (VALUES {rows}) e(h, u, k, v)) TO '{path}' (FORMAT parquet)")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    made = series_queries._hourly_panel(spark, str(tmp_path))
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = db.execute(series_queries.PANEL + "SELECT item, channel, t, y FROM panel").fetchall()
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, want)) and len(want) == 4 * 2 * 720


def test_sliding_statistics_match_sums_over_dates(spark):
    rng = np.random.default_rng(8)
    rows = [("a", t, f"{t}", h, 2.0, float(rng.normal()), rng.normal(size=2).tolist()) for t in range(0, 60, 3) for h in range(4)]
    df = spark.createDataFrame(rows, "item string, tick long, window string, h int, scale double, residual double, x array<double>")
    for r in ridge.sliding_statistics(df, ["item"], "tick", 2, 5).collect():
        own = [w for w in rows if r.tick - 12 <= w[1] <= r.tick]
        x = np.array([w[6] for w in own]) / 2
        assert r.xtx == pytest.approx([(x[:, 0] ** 2).sum(), (x[:, 0] * x[:, 1]).sum(), (x[:, 1] ** 2).sum()])
        assert r.rows == len(own) and r.windows == len({w[2] for w in own})


def test_stored_tables_are_written_once_for_each_state_of_their_source(spark, tmp_path):
    source, made = f"{tmp_path}/source", []

    def make():
        made.append(1)
        return spark.read.parquet(source)

    spark.range(3).write.parquet(source)
    assert stages.stored(spark, source, "copy", make).count() == stages.stored(spark, source, "copy", make).count() == 3 and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    assert stages.stored(spark, source, "copy", make).count() == 5 and len(made) == 2


def test_scope_counts_match_pairs(spark):
    rng = np.random.default_rng(9)
    asked, store = spark.createDataFrame(refs(rng, 40), SCHEMA), spark.createDataFrame(refs(rng, 200), SCHEMA)
    got = {r.query_id: (r.eligible, r.same_series, r.other_series) for r in retrieval.scope_counts(asked, store, 12, 6).collect()}
    each = [{r.query_id: r["count"] for r in retrieval.eligible(asked, store, 12, 6, s).groupBy("query_id").count().collect()} for s in ("all", "same_series", "other_series")]
    assert got == {q: tuple(e.get(q, 0) for e in each) for q in each[0]}
    assert metrics.WINDOW == ["item", "channel", "window"]
