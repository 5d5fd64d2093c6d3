"""The family of adaptors over extracted rows, fitted in one pass over training rows and judged in one over validation rows.

Members: vanilla; Bayes mixtures of vanilla with the forecast from K neighbours or from past targets, weighted
by the posterior share of training windows that it wins; ridges on nested features (covariate, targets, full)
of each K and penalty, shared by a task or, for the full features, one for each variate.  Statistics of all K come from
one pass, those of nested features are parts of them.  A member takes part if more training windows than
TRAIN_RATIO and more validation windows than VALIDATION_RATIO times the test windows can be adapted.
Rows have task, item, channel, split, tick, scale and what extraction.extract gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import extraction
from .ridge import ALPHAS, Bootstrap, choose, feature_indices, solve_matrix, width

#: Windows of a split a member needs, as a part of the test windows.
TRAIN_RATIO, VALIDATION_RATIO = 1.0, 0.1
KINDS = ("covariate", "targets", "full")
SERIES = ["task", "item", "channel"]
_STATS = "task string, item string, channel int, split string, k int, xtx array<double>, xty array<double>, yy double, rows long, windows long"


def _design(vanilla: np.ndarray, context: np.ndarray, neighbours: list, own: list, k: int) -> np.ndarray:
    """Features V, C, Y1..Yk, N1..Nk of a window, a row for each step."""
    return np.column_stack([vanilla, context, *neighbours[:k], *own[:k]]).astype(float)


def _array(values) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], dtype=float)


def statistics(rows: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Sums of products of each series, split and K over the rows that can be adapted, in one pass; added up within tasks first."""
    flags = [extraction.adapted(k).alias(f"_adapted_{k}") for k in ks]
    columns = [*SERIES, "split", "scale", "target", "vanilla", "neighbours", "own", *[f"context_{k}" for k in ks]]
    chosen = rows.where(F.col("split").isin("train", "validation")).select(*[F.col(c).cast("int") if c == "channel" else F.col(c) for c in columns], *flags)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for r in batch.to_dict("records"):
                s = max(r["scale"] or 0.0, 1e-8)
                for k in ks:
                    if not r[f"_adapted_{k}"]:
                        continue
                    vanilla = _array(r["vanilla"])
                    x = _design(vanilla, _array(r[f"context_{k}"]), list(r["neighbours"]), list(r["own"]), k) / s
                    y = (_array(r["target"]) - vanilla) / s
                    own = held.setdefault((r["task"], r["item"], r["channel"], r["split"], k), [0.0, 0.0, 0.0, 0, 0])
                    for i, value in enumerate((x.T @ x, x.T @ y, float(y @ y), len(y), 1)):
                        own[i] = own[i] + value
        yield pd.DataFrame([(*key, v[0].ravel().tolist(), v[1].tolist(), *v[2:]) for key, v in held.items()], columns=[c.split()[0] for c in _STATS.split(", ")])

    return _merged(chosen.mapInPandas(add, _STATS), [*SERIES, "split", "k"])


def _merged(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of unions; a group is one row from each task, at most."""
    kinds = {f.name: f.dataType.simpleString() for f in stats.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", xtx array<double>, xty array<double>, yy double, rows long, windows long"

    def total(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, np.sum([np.asarray(x) for x in part.xtx], axis=0).tolist(), np.sum([np.asarray(x) for x in part.xty], axis=0).tolist(), part.yy.sum(), part.rows.sum(), part.windows.sum())], columns=[*keys, "xtx", "xty", "yy", "rows", "windows"])

    return stats.groupBy(*keys).applyInPandas(total, schema)


def _ridges(stats: DataFrame, keys: list[str], kinds: tuple[str, ...], alphas: tuple[float, ...], prefix: str) -> DataFrame:
    """keys, method, k, alpha, beta (over the full features, zeros where left out) of every kind and penalty, out of each row's sums."""
    names = {f.name: f.dataType.simpleString() for f in stats.schema.fields}
    schema = ", ".join(f"{k} {names[k]}" for k in keys) + ", method string, k int, alpha double, beta array<double>"

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                f = width("full", r["k"])
                xtx, xty = np.asarray(r["xtx"]).reshape(f, f), np.asarray(r["xty"])
                for kind in kinds:
                    at = feature_indices(kind, r["k"])
                    for alpha in alphas:
                        beta = np.zeros(f)
                        beta[at] = solve_matrix(xtx[np.ix_(at, at)], xty[at], float(r["rows"]), alpha)
                        out.append((*[r[k] for k in keys], f"{prefix}{kind}_ridge", r["k"], alpha, beta.tolist()))
            yield pd.DataFrame(out, columns=[*keys, "method", "k", "alpha", "beta"])

    return stats.mapInPandas(fit, schema)


def evidence(rows: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """task, method, k, p: the posterior chance that a mixture's forecast beats vanilla, over training windows."""
    s = F.greatest("scale", F.lit(1e-8))

    def loss(c: str) -> F.Column:
        e = F.zip_with("target", c, lambda y, f: ((y - f) / s) * ((y - f) / s))
        return F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / F.size("target")

    kinds = [F.struct(F.lit("bayes_covariate").alias("method"), F.lit(k).alias("k"), F.when(extraction.adapted(k), loss(f"context_{k}")).alias("candidate")) for k in ks]
    kinds.append(F.struct(F.lit("bayes_past_targets").alias("method"), F.lit(0).alias("k"), F.when(extraction.whole(F.col("past")), loss("past")).alias("candidate")))
    each = rows.where((F.col("split") == "train") & extraction.labelled()).select("task", loss("vanilla").alias("vanilla"), F.explode(F.array(*kinds)).alias("m"))
    won = F.when(F.col("m.candidate") < F.col("vanilla"), 1.0).when(F.col("m.candidate") == F.col("vanilla"), 0.5).otherwise(0.0)
    counted = each.where("m.candidate is not null").groupBy("task", "m.method", "m.k").agg(F.sum(won).alias("wins"), F.count("*").alias("trials"))
    return counted.withColumn("p", (1 + F.col("wins")) / (2 + F.col("trials")))


def members(rows: DataFrame, ks: tuple[int, ...], alphas: tuple[float, ...] = ALPHAS, train_ratio: float = TRAIN_RATIO, validation_ratio: float = VALIDATION_RATIO) -> tuple[DataFrame, DataFrame]:
    """The members that pass the gates: (task, method, k, alpha, beta, p), and those of single variates (task, item, channel, method, k, alpha, beta)."""
    seen = extraction.coverage(rows, [*SERIES, "split"], ks).select(*SERIES, "split", "k", "adapted_windows")
    tests = rows.where("split = 'test'").groupBy(*SERIES).agg(F.count("*").alias("tests"))

    def passing(keys: list[str]) -> DataFrame:
        n = seen.groupBy(*keys, "k").agg(*[F.sum(F.when(F.col("split") == s, F.col("adapted_windows")).otherwise(0)).alias(s) for s in ("train", "validation")])
        n = n.join(tests.groupBy(*keys).agg(F.sum("tests").alias("tests")), keys)
        return n.where((F.col("train") > train_ratio * F.col("tests")) & (F.col("validation") > validation_ratio * F.col("tests"))).select(*keys, "k")

    stats = statistics(rows, ks).where("split = 'train'")
    shared = _merged(stats, ["task", "k"]).join(passing(["task"]), ["task", "k"])
    single = stats.join(passing(SERIES).withColumn("channel", F.col("channel").cast("int")), [*SERIES, "k"])
    ridges = _ridges(shared, ["task"], KINDS, alphas, "").withColumn("p", F.lit(None).cast("double"))
    won = evidence(rows, ks)
    mixtures = won.join(passing(["task"]), ["task", "k"], "left_semi").unionByName(won.where("method = 'bayes_past_targets'"))
    mixtures = mixtures.select("task", "method", "k", F.lit(None).cast("double").alias("alpha"), F.lit(None).cast("array<double>").alias("beta"), "p")
    return mixtures.unionByName(ridges), _ridges(single, SERIES, ("full",), alphas, "per_variate_")


def forecasts(rows: DataFrame, shared: DataFrame, single: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """task, item, channel, ref_id, tick, method, k, alpha, yhat, fallback, msse: every member on every row, in one pass; vanilla wherever a row cannot be adapted or a forecast is not finite."""
    member = F.struct("method", "k", "alpha", "beta", F.col("p"))
    # Variates without a fit of their own keep vanilla under its name, so that all members are judged on the same rows.
    others = single.select("task", "method", "k", "alpha").distinct().withColumns({"beta": F.lit(None).cast("array<double>"), "p": F.lit(None).cast("double")})
    by_task = shared.unionByName(others).groupBy("task").agg(F.collect_list(member).alias("_shared"))  # a few dozen members
    by_series = single.withColumn("p", F.lit(None).cast("double")).groupBy(*SERIES).agg(F.collect_list(member).alias("_single"))
    held = rows.withColumn("channel", F.col("channel").cast("int")).join(by_task, "task", "left").join(by_series, SERIES, "left")
    flags = [extraction.adapted(k).alias(f"_adapted_{k}") for k in ks]
    columns = [*SERIES, "ref_id", "tick", "scale", "target", "vanilla", "past", "neighbours", "own", "_shared", "_single", *[f"context_{k}" for k in ks]]
    kinds = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*SERIES, "ref_id", "tick"]) + ", method string, k int, alpha double, yhat array<double>, fallback boolean, msse double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                vanilla, target = _array(r["vanilla"]), _array(r["target"])
                every = [{"method": "vanilla", "k": 0, "alpha": None, "beta": None, "p": None}]
                single_ = list(r["_single"]) if r["_single"] is not None else []
                fitted = {(m["method"], m["k"], m["alpha"]) for m in single_}
                every += [m for m in (r["_shared"] if r["_shared"] is not None else []) if (m["method"], m["k"], m["alpha"]) not in fitted] + single_
                for m in every:
                    k, made = m["k"], None
                    if m["method"] == "bayes_past_targets":
                        made = None if r["past"] is None else (1 - m["p"]) * vanilla + m["p"] * _array(r["past"])
                    elif m["method"] != "vanilla" and (m["p"] is not None or m["beta"] is not None) and r[f"_adapted_{k}"]:
                        context = _array(r[f"context_{k}"])
                        if m["p"] is not None:
                            made = (1 - m["p"]) * vanilla + m["p"] * context
                        else:
                            made = vanilla + _design(vanilla, context, list(r["neighbours"]), list(r["own"]), k) @ np.asarray(m["beta"])
                    fallback = m["method"] != "vanilla" and (made is None or not np.isfinite(made).all())
                    yhat = vanilla if made is None or fallback else made
                    e = (target - yhat) / max(r["scale"] or 0.0, 1e-8)
                    msse = float(np.mean(e * e)) if np.isfinite(e).all() else None
                    out.append((*[r[c] for c in [*SERIES, "ref_id", "tick"]], m["method"], k, m["alpha"], yhat.tolist(), fallback, msse))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.replace("array<double>", "x").split(", ")])

    return held.select(*columns, *flags).mapInPandas(run, schema)


def fit(rows: DataFrame, horizon: int, stride: int, ks: tuple[int, ...], alphas: tuple[float, ...] = ALPHAS, b: Bootstrap = Bootstrap(), train_ratio: float = TRAIN_RATIO, validation_ratio: float = VALIDATION_RATIO) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members shared, members single, choice of each method family, overall choice), both choices as ridge.choose gives them.

    Each family is judged against vanilla by one-standard-error choice on validation dates, then the families'
    choices against each other.
    """
    shared, single = members(rows, ks, alphas, train_ratio, validation_ratio)
    judged = forecasts(rows.where("split = 'validation'"), shared, single, ks).where("msse is not null")
    losses = judged.groupBy("task", "method", "k", F.coalesce("alpha", F.lit(0.0)).alias("alpha"), "tick").agg(F.avg("msse").alias("loss"))
    names = losses.where("method <> 'vanilla'").select("task", F.col("method").alias("family")).distinct()
    vanilla = losses.where("method = 'vanilla'").join(names, "task")
    families = losses.where("method <> 'vanilla'").withColumn("family", F.col("method")).unionByName(vanilla)
    by_family = choose(families, ["task", "family"], horizon, stride, b)
    kept = by_family.where("selected").select("task", "method", "k", "alpha").unionByName(losses.where("method = 'vanilla'").select("task", "method", "k", "alpha")).distinct()
    overall = choose(losses.join(kept, ["task", "method", "k", "alpha"], "left_semi"), ["task"], horizon, stride, b)
    return shared, single, by_family, overall
