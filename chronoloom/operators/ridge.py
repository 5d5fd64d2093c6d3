"""Ridge adaptors from mergeable sufficient statistics, and their selection.

Rows of a design have their group's keys, window, scale, residual and x, an array of features.
Statistics are sums of products, aggregated partially before any shuffle; only they, a few numbers for
each group, reach the solver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grid of neighbours and penalties.
KS, ALPHAS = (1, 5, 10, 15), (1e-3, 1e-2, 1e-1)
PRIMARY_K, PRIMARY_ALPHA = 10, 1e-2


def feature_names(k: int) -> list[str]:
    return ["V", "C", *[f"Y{i}" for i in range(1, k + 1)], *[f"N{i}" for i in range(1, k + 1)]]


def feature_indices(kind: str, k: int) -> list[int]:
    """Places of a nested selection: covariate (V, C), targets (V, Y) or full."""
    names = feature_names(k)
    keep = {"covariate": lambda n: n in "VC", "targets": lambda n: n[0] in "VY", "full": lambda n: True}[kind]
    return [i for i, n in enumerate(names) if keep(n)]


def statistics(design: DataFrame, keys: list[str], f: int) -> DataFrame:
    """keys, xtx (upper triangle by rows), xty, yy, rows, windows: sums over x/s and y/s, s the scale (1e-8 at least)."""
    s = F.greatest(F.col("scale"), F.lit(1e-8))
    scaled = design.select(*keys, "window", *[(F.get("x", F.lit(i)) / s).alias(f"_x{i}") for i in range(f)], (F.col("residual") / s).alias("_y"))
    finite = lambda c: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit("a design value is not finite")).cast("double")).otherwise(c)
    x = [finite(F.col(f"_x{i}")) for i in range(f)]
    y = finite(F.col("_y"))
    sums = [F.sum(x[i] * x[j]).alias(f"_xx{i}_{j}") for i in range(f) for j in range(i, f)] + [F.sum(a * y).alias(f"_xy{i}") for i, a in enumerate(x)]
    agg = scaled.groupBy(*keys).agg(*sums, F.sum(y * y).alias("yy"), F.count("*").alias("rows"), F.countDistinct("window").alias("windows"))
    return agg.select(*keys, F.array(*[f"_xx{i}_{j}" for i in range(f) for j in range(i, f)]).alias("xtx"), F.array(*[f"_xy{i}" for i in range(f)]).alias("xty"), "yy", "rows", "windows")


def merge(stats: DataFrame, keys: list[str], f: int) -> DataFrame:
    """The statistics of unions: sums of sums."""
    n = f * (f + 1) // 2
    total = lambda name, size: F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(size)]).alias(name)
    return stats.groupBy(*keys).agg(total("xtx", n), total("xty", f), F.sum("yy").alias("yy"), F.sum("rows").alias("rows"), F.sum("windows").alias("windows"))


def triangle(f: int, i: int, j: int) -> int:
    i, j = min(i, j), max(i, j)
    return i * f - i * (i - 1) // 2 + j - i


def select(stats: DataFrame, f: int, keep: list[int]) -> DataFrame:
    """The statistics of some of the features."""
    xtx = [F.get("xtx", F.lit(triangle(f, a, b))) for p, a in enumerate(keep) for b in keep[p:]]
    return stats.withColumn("xtx", F.array(*xtx)).withColumn("xty", F.array(*[F.get("xty", F.lit(i)) for i in keep]))


def solve_matrix(xtx: np.ndarray, xty: np.ndarray, n: float, alpha: float) -> np.ndarray:
    """Coefficients of features brought to unit root mean square; least squares where the system is singular."""
    r = np.maximum(np.sqrt(np.diag(xtx) / n), 1e-12)
    a = xtx / np.outer(r, r) / n + alpha * np.eye(len(r))
    b = xty / r / n
    try:
        return np.linalg.solve(a, b) / r
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0] / r


def solve(stats: DataFrame, f: int, alpha: float, count: str = "rows") -> DataFrame:
    """stats with beta; count is the column the sums are divided by."""

    @F.pandas_udf("array<double>")
    def beta(xtx: pd.Series, xty: pd.Series, n: pd.Series) -> pd.Series:
        upper = np.triu_indices(f)
        out = []
        for a, b, k in zip(xtx, xty, n, strict=True):
            m = np.zeros((f, f))
            m[upper] = a
            out.append(solve_matrix(m + np.triu(m, 1).T, np.asarray(b, dtype=float), float(k), alpha))
        return pd.Series(out)

    return stats.withColumn("beta", beta("xtx", "xty", count))


def solve_pair(alpha: float) -> list[Column]:
    """The two coefficients of a two-feature ridge as expressions on xtx, xty, rows."""
    g = lambda c, i: F.get(c, F.lit(i))
    n = F.col("rows")
    r0, r1 = (F.greatest(F.sqrt(g("xtx", i) / n), F.lit(1e-12)) for i in (0, 2))
    a, d = g("xtx", 0) / (r0 * r0) / n + alpha, g("xtx", 2) / (r1 * r1) / n + alpha
    b = g("xtx", 1) / (r0 * r1) / n
    p, q = g("xty", 0) / r0 / n, g("xty", 1) / r1 / n
    det = a * d - b * b
    return [(d * p - b * q) / det / r0, (a * q - b * p) / det / r1]


def mean_squared_error(f: int) -> Column:
    """(yy - 2 b'xty + b' xtx b) / rows, 0 at least, on stats with beta."""
    b = lambda i: F.get("beta", F.lit(i))
    quad = sum((b(i) * b(j) * F.get("xtx", F.lit(triangle(f, i, j))) for i in range(f) for j in range(f)), F.lit(0.0))
    cross = sum((b(i) * F.get("xty", F.lit(i)) for i in range(f)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.try_divide(F.col("yy") - 2 * cross + quad, F.col("rows")))


def predict(vanilla: Column, x: Column, beta: Column, usable: Column) -> Column:
    """vanilla + x.beta where usable and finite, else vanilla."""
    value = vanilla + F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.when(usable & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value).otherwise(vanilla)


def mixture(p: Column, vanilla: Column, covariate: Column) -> Column:
    return (1 - p) * vanilla + p * covariate


def win_evidence(losses: DataFrame, keys: list[str]) -> DataFrame:
    """wins (ties count a half), trials and the posterior mean under a uniform prior; losses has candidate, vanilla."""
    c, v = F.col("candidate"), F.col("vanilla")
    won = F.sum(F.when(c < v, 1.0).when(c == v, 0.5).otherwise(0.0))
    agg = losses.where(c.isNotNull() & v.isNotNull()).groupBy(*keys).agg(won.alias("wins"), F.count("*").alias("trials"))
    return agg.withColumn("p", F.when(F.col("trials") > 0, (1 + F.col("wins")) / (2 + F.col("trials"))).otherwise(0.0))


def date_losses(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tick, loss: the mean over a date's windows of their mean scaled squared errors; cells has item, channel, tick, y, yhat, scale."""
    e = (F.col("y") - F.col("yhat")) / F.greatest("scale", F.lit(1e-8))
    per = cells.where(F.col("y").isNotNull()).groupBy(*keys, "tick", "item", "channel").agg(F.avg(e * e).alias("msse"))
    return per.groupBy(*keys, "tick").agg(F.avg("msse").alias("loss"))


@dataclass(frozen=True)
class Bootstrap:
    replications: int = 1000
    seed: int = 0
    block: int | None = None


def block_length(dates: int, horizon: int, stride: int, b: Bootstrap) -> int:
    automatic = max(1, round(dates ** (1 / 3)), -(-horizon // stride))
    return 1 if dates < 2 else min(b.block or automatic, dates - 1)


def standard_error(differences: np.ndarray, length: int, b: Bootstrap, offset: int = 0) -> float:
    """Of the mean of paired differences, by moving blocks whose starts a seeded generator draws."""
    n = len(differences)
    if n < 2:
        return 0.0
    rng = np.random.default_rng(b.seed + offset)
    sums = np.zeros(b.replications)
    for at in range(0, n, length):
        width = min(length, n - at)
        starts = rng.integers(0, n - length + 1, size=b.replications)
        within = np.concatenate([[0.0], np.cumsum(differences)])
        sums += within[starts + width] - within[starts]
    return float(np.std(sums / n, ddof=1))


def choose(losses: DataFrame, task: list[str], horizon: int, stride: int, b: Bootstrap = Bootstrap(), offset: int = 0) -> DataFrame:
    """The one-standard-error choice of each task: task, method, k, alpha, mean_loss, difference, standard_error, selected.

    losses has task, method, k, alpha, tick, loss, the same dates for each candidate: a few numbers for
    each date, of one task at a time.  Within a standard error of the best, vanilla comes first, then
    fewer neighbours, larger penalties, names.
    """
    fields = {f.name: f.dataType.simpleString() for f in losses.schema.fields}
    schema = ", ".join(f"`{t}` {fields[t]}" for t in task) + ", method string, k int, alpha double, mean_loss double, difference double, standard_error double, selected boolean"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(k=rows.k.fillna(0).astype(int), alpha=rows.alpha.fillna(0.0))
        table = rows.pivot_table(index="tick", columns=["method", "k", "alpha"], values="loss", aggfunc="mean").sort_index()
        if table.isna().any().any():
            raise ValueError("candidates do not share their dates")
        rank = lambda c: (c[0] != "vanilla", c[1], -c[2], c[0])
        means = table.mean()
        best = min(table.columns, key=lambda c: (means[c], rank(c)))
        length = block_length(len(table), horizon, stride, b)
        out = []
        for c in table.columns:
            d = (table[c] - table[best]).to_numpy()
            out.append((*key, c[0], int(c[1]), float(c[2]), float(means[c]), float(d.mean()), standard_error(d, length, b, offset)))
        within = [r for r in out if r[-2] <= r[-1] + 1e-12]
        pick = min(within, key=lambda r: rank(r[len(key) : len(key) + 3]))
        return pd.DataFrame([(*r, r is pick) for r in out], columns=[*task, "method", "k", "alpha", "mean_loss", "difference", "standard_error", "selected"])

    return losses.groupBy(*task).applyInPandas(run, schema)


def sliding_statistics(design: DataFrame, keys: list[str], date: str, f: int, dates: int) -> DataFrame:
    """keys, date and the statistics of the newest dates up to each: those of a date are added as it comes and taken off again as it leaves, which the frame of a window function does."""
    from pyspark.sql import Window as W

    newest = W.partitionBy(*keys).orderBy(date).rowsBetween(1 - dates, 0)
    daily = statistics(design, [*keys, date], f)
    total = lambda name, size: F.array(*[F.sum(F.get(name, F.lit(i))).over(newest) for i in range(size)]).alias(name)
    return daily.select(*keys, date, total("xtx", f * (f + 1) // 2), total("xty", f), *[F.sum(c).over(newest).alias(c) for c in ("yy", "rows", "windows")])


def horizon_ridge(fitting: DataFrame, queries: DataFrame, f: int, alpha: float, least: int = 64, most: int = 100) -> DataFrame:
    """query_id, h, beta: a ridge for every query and step over its newest dates; queries of fewer than least have none.

    fitting has query_id, tick, window, h, scale, residual, x; the sums are divided by the windows.
    """
    from pyspark.sql import Window as W

    ranked = fitting.withColumn("_r", F.dense_rank().over(W.partitionBy("query_id").orderBy(F.desc("tick")))).where(F.col("_r") <= most)
    stats = statistics(ranked, ["query_id", "h"], f).where(F.col("windows") >= least)
    return solve(stats, f, alpha, "windows").select("query_id", "h", "beta", "windows").join(queries.select("query_id"), "query_id", "left_semi")


def nested(rows: DataFrame, kind: str, k: int) -> DataFrame:
    """rows (vanilla, covariate, neighbours and own: the neighbours' actual futures and the forecasts made there, in order of distance) with x, the features of a nested selection."""
    parts = {"covariate": ["vanilla", "covariate"], "targets": ["vanilla"], "full": ["vanilla", "covariate"]}[kind]
    x = F.array(*parts)
    if kind != "covariate":
        x = F.concat(x, F.slice("neighbours", 1, k))
    return rows.withColumn("x", F.concat(x, F.slice("own", 1, k)) if kind == "full" else x)


def width(kind: str, k: int) -> int:
    return {"covariate": 2, "targets": 1 + k, "full": 2 + 2 * k}[kind]


def statistics_grid(rows: DataFrame, keys: list[str], kinds: tuple[str, ...], ks: tuple[int, ...]) -> dict[tuple[str, int], DataFrame]:
    """Statistics for each kind and number of neighbours, of rows that have that many."""
    return {(kind, k): statistics(nested(rows.where(F.size("neighbours") >= k), kind, k), keys, width(kind, k)) for kind in kinds for k in ks}


def fit_family(train: DataFrame, validation: DataFrame, task: list[str], horizon: int, stride: int, ks: tuple[int, ...] = KS, alphas: tuple[float, ...] = ALPHAS, kinds: tuple[str, ...] = ("covariate", "targets", "full"), by_variate: bool = False, b: Bootstrap = Bootstrap()) -> DataFrame:
    """The choice of each task among vanilla, the Bayes mixture and ridges of each kind, K and penalty.

    Both frames have task, item, channel, window, tick, h, scale, y, residual, vanilla, covariate, neighbours, own.
    Candidates are fitted on train and judged on validation, each in a pass of its own, so both had better be
    written or persisted; a row with too few neighbours keeps vanilla.
    """
    keys = [*task, "item", "channel"] if by_variate else task
    s = F.greatest("scale", F.lit(1e-8))
    loss = lambda f: F.avg(F.pow((F.col("y") - F.col(f)) / s, 2))
    wins = train.groupBy(*task, "item", "channel", "window").agg(loss("covariate").alias("candidate"), loss("vanilla").alias("vanilla"))
    evidence = win_evidence(wins, task).select(*task, "p")

    def judged(rows: DataFrame, method: str, k: int, alpha: float | None) -> DataFrame:
        return date_losses(rows, task).withColumns({"method": F.lit(method), "k": F.lit(k), "alpha": F.lit(alpha).cast("double")})

    losses = [judged(validation.withColumn("yhat", F.col("vanilla")), "vanilla", 0, None)]
    losses.append(judged(validation.join(evidence, task).withColumn("yhat", mixture(F.col("p"), F.col("vanilla"), F.col("covariate"))), "bayes", 0, None))
    for (kind, k), stats in statistics_grid(train, keys, kinds, ks).items():
        if kind == "covariate" and k != ks[0]:
            continue
        for alpha in alphas:
            beta = solve(stats, width(kind, k), alpha).select(*keys, "beta")
            rows = nested(validation, kind, k).join(beta, keys, "left")
            usable = (F.size("neighbours") >= k) & F.col("beta").isNotNull()
            losses.append(judged(rows.withColumn("yhat", predict(F.col("vanilla"), F.col("x"), F.col("beta"), usable)), f"{kind}_ridge", k, alpha))
    every = losses[0]
    for one in losses[1:]:
        every = every.unionByName(one)
    return choose(every, task, horizon, stride, b)
