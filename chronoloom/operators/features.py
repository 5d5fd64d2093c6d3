"""Features of series: moments, periods, heterogeneity, and a decomposition's.

What SQL can say is window functions and aggregates; spectra and the decomposition, which need a whole
series at once, are NumPy in one grouped pass.  The decomposition is classical: a centred moving
average as trend (its ends extended in a line), phase means (made to sum to zero) as season, the rest as remainder.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .series import SERIES, blocks

# Candidate periods by frequency, and how far from them a spectrum's share is counted.
PERIODS = {"S": [60, 3600, 43200, 86400], "T": [60, 720, 1440, 10080], "H": [12, 24, 168, 720], "D": [7, 30, 91, 365], "B": [5, 21, 63, 252], "W": [4, 13, 52], "M": [12], "Q": [4], "A": [1]}
MARGINS = {"S": [10, 600, 3600, 7200], "T": [10, 60, 120, 720], "H": [1, 2, 12, 24], "D": [1, 3, 7, 14], "B": [1, 3, 5, 10], "W": [1, 2, 4], "M": [1], "Q": [1], "A": [0]}
BINS = 32


def moments(panel: DataFrame) -> DataFrame:
    return panel.groupBy(*SERIES).agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.avg(F.col("y").isNull().cast("int")).alias("missing_rate"), F.count("*").alias("length"))


def standardised(panel: DataFrame, value: str = "filled") -> DataFrame:
    w = W.partitionBy(*SERIES)
    s = F.stddev_samp(value).over(w)
    return panel.withColumn("z", F.when(s < 1e-8, F.col(value)).otherwise((F.col(value) - F.avg(value).over(w)) / F.nullif(s, F.lit(0.0))))


def temporal_heterogeneity(panel: DataFrame, value: str = "filled") -> DataFrame:
    """Location (variance of block means over the variance) and scale (1 - exp(-variance of log block deviations)); 0 under 16 steps."""
    w = W.partitionBy(*SERIES)
    n = F.count("*").over(w)
    p = panel.withColumn("_n", n).withColumn("_v", F.var_pop(value).over(w))
    number = F.least(F.lit(4), F.greatest(F.lit(2), F.floor(F.col("_n") / 8)))
    rank, per = F.row_number().over(w.orderBy("t")) - 1, F.floor(F.col("_n") / number)
    extra = F.col("_n") - per * number
    block = F.when(rank < extra * (per + 1), F.floor(rank / (per + 1))).otherwise(extra + F.floor((rank - extra * (per + 1)) / F.greatest(per, F.lit(1))))
    b = p.withColumn("block", block).groupBy(*SERIES, "block").agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.first("_v").alias("v"), F.first("_n").alias("n"))
    ref = F.greatest(F.sqrt("v"), F.lit(1e-12))
    agg = b.groupBy(*SERIES).agg(F.var_pop("m").alias("between"), F.first("v").alias("v"), F.var_pop(F.ln((F.col("s") + 1e-12) / ref)).alias("ls"), F.first("n").alias("n"))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    few = F.col("n") < 16
    return agg.select(*SERIES, F.when(few | (F.col("v") <= 1e-12), 0.0).otherwise(clip(F.col("between") / F.nullif(F.col("v"), F.lit(0.0)))).alias("location"), F.when(few, 0.0).otherwise(clip(1 - F.exp(-F.col("ls")))).alias("scale"))


def spatial_heterogeneity(panel: DataFrame, value: str = "filled") -> DataFrame:
    """One row: location (between over between and within) and scale differences between variates; 0 for fewer than two."""
    u = panel.groupBy(*SERIES).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    one = u.agg(F.count("*").alias("n"), F.var_pop("m").alias("between"), F.avg("v").alias("within"), F.percentile(F.sqrt("v"), F.lit(0.5)).alias("ref"))
    logs = u.join(F.broadcast(one)).agg(F.var_pop(F.ln((F.sqrt("v") + 1e-12) / F.greatest("ref", F.lit(1e-12)))).alias("ls"), F.max("n").alias("n"), F.max("between").alias("between"), F.max("within").alias("within"))
    total = F.col("between") + F.col("within")
    return logs.select(F.when((F.col("n") < 2) | (total <= 1e-12), 0.0).otherwise(F.col("between") / F.nullif(total, F.lit(0.0))).alias("location"), F.when(F.col("n") < 2, 0.0).otherwise(1 - F.exp(-F.col("ls"))).alias("scale"))


def period_strengths(x: np.ndarray, unit: str, multiple: int = 1) -> dict[str, float]:
    """The three candidate periods with the largest shares of the amplitude spectrum around them."""
    amplitude = np.abs(np.fft.fft(x))
    amplitude[0] = 0
    half = len(x) // 2
    f, a = np.fft.fftfreq(len(x))[:half], amplitude[:half]
    total, found = a.sum(), []
    for p, d in zip([max(p // multiple, 1) for p in PERIODS[unit]], [m / multiple for m in MARGINS[unit]], strict=True):
        if p < len(x):
            width = abs(1 / (p - d) - 1 / (p + d)) / 2 if p != d else np.inf
            share = a[(f >= 1 / p - width) & (f <= 1 / p + width)].sum() / total if total > 0 else 0.0
            found.append((p, round(float(share), 3)))
    best = sorted(found, key=lambda t: -t[1])[:3] + [(np.nan, np.nan)] * 3
    return {f"{name}{i + 1}": float(best[i][j]) for j, name in enumerate(("period", "strength")) for i in range(3)}


def spectrum(x: np.ndarray) -> np.ndarray:
    """The power spectrum on BINS places and one bin for a constant, summing to one."""
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    power[:1] = 0
    out = np.zeros(BINS + 1)
    if power.sum() <= 1e-12:
        out[0] = 1
        return out
    out[1:] = np.interp(np.linspace(0, 1, BINS), np.linspace(0, 1, len(power)), power)
    return out / out.sum()


def divergence(spectra: np.ndarray) -> float:
    """Mean Jensen-Shannon divergence, in bits, from each spectrum to their mean."""
    if len(spectra) < 2:
        return 0.0
    ref = spectra.mean(axis=0)
    mid = (spectra + ref) / 2
    kl = lambda p: np.where(p > 0, p * np.log(np.where(p > 0, p, 1) / np.where(mid > 0, mid, 1)), 0).sum(axis=1)
    return float(np.clip(((kl(spectra) + kl(np.broadcast_to(ref, spectra.shape))) / 2 / math.log(2)).mean(), 0, 1))


def frequency_heterogeneity(x: np.ndarray) -> float:
    if len(x) < 16:
        return 0.0
    return divergence(np.array([spectrum(b) for b in np.array_split(x, min(4, max(2, len(x) // 8)))]))


def _acf(x: np.ndarray, lags: int = 10) -> np.ndarray:
    if len(x) <= lags or np.var(x) < 1e-8:
        return np.full(lags, np.nan)
    d = x - x.mean()
    return np.array([(d[:-k] * d[k:]).sum() / ((len(x) - k) * np.var(x)) for k in range(1, lags + 1)])


def _scaled(x: np.ndarray) -> np.ndarray:
    s = x.std(ddof=1) if len(x) > 1 else 0.0
    return (x - x.mean()) / s if s > 1e-8 else x - x.mean()


def spectral_entropy(x: np.ndarray) -> float:
    p = np.abs(np.fft.rfft(_scaled(x))[1:]) ** 2
    p = p / p.sum() if p.sum() > 0 else np.ones(max(1, len(p))) / max(1, len(p))
    return float(-(p[p > 0] * np.log(p[p > 0])).sum() / math.log(max(2, len(p))))


def _tiles(x: np.ndarray, m: int) -> np.ndarray:
    width = m if m > 1 else 10
    return _scaled(x)[: len(x) // width * width].reshape(-1, width)


def stability(x: np.ndarray, m: int) -> float:
    t = _tiles(x, m)
    return float(t.mean(axis=1).var(ddof=1)) if len(t) > 1 else 0.0


def lumpiness(x: np.ndarray, m: int) -> float:
    t = _tiles(x, m)
    return float(t.var(axis=1, ddof=1).var(ddof=1)) if len(t) > 1 else 0.0


def hurst(x: np.ndarray) -> float:
    """The slope of log rescaled range on log length, over halved lengths."""
    sizes, points = [], []
    size = len(x)
    while size >= 8:
        parts = x[: len(x) // size * size].reshape(-1, size)
        walk = np.cumsum(parts - parts.mean(axis=1, keepdims=True), axis=1)
        s = parts.std(axis=1)
        if (s > 1e-12).any():
            sizes.append(math.log(size))
            points.append(math.log(max(1e-12, ((walk.max(axis=1) - walk.min(axis=1))[s > 1e-12] / s[s > 1e-12]).mean())))
        size //= 2
    return float(np.polyfit(sizes, points, 1)[0]) if len(sizes) > 1 else float("nan")


def _residual(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return y - x @ np.linalg.lstsq(x, y, rcond=None)[0]


def nonlinearity(x: np.ndarray) -> float:
    """Ten times the log ratio of squared residuals of a first-order autoregression without and with square and cubic terms."""
    z = _scaled(x)
    y, l1 = z[1:], z[:-1]
    one = np.ones_like(l1)
    a = (_residual(y, np.column_stack([one, l1])) ** 2).sum()
    b = (_residual(y, np.column_stack([one, l1, l1**2, l1**3])) ** 2).sum()
    return float(10 * math.log(max(a, 1e-300) / max(b, 1e-300)))


def arch(x: np.ndarray, lags: int = 12) -> float:
    """The share of the variance of squares that lagged squares explain."""
    s = (x - x.mean()) ** 2
    if len(s) <= 2 * lags or s.var() < 1e-12:
        return float("nan")
    y = s[lags:]
    e = _residual(y, np.column_stack([np.ones(len(y)), *[s[lags - k : -k] for k in range(1, lags + 1)]]))
    return float(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())


def shapiro_w(x: np.ndarray) -> float:
    """W by Royston's approximation of the weights."""
    from statistics import NormalDist

    n = len(x)
    if n < 12 or x.std() < 1e-12:
        return float("nan")
    inv = NormalDist().inv_cdf
    m = np.array([inv((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, c = 1 / math.sqrt(n), m / math.sqrt((m * m).sum())
    last = c[-1] + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
    next_ = c[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
    a = m / math.sqrt(((m * m).sum() - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2))
    a[-1], a[-2], a[0], a[1] = last, next_, -last, -next_
    return float((a @ np.sort(x)) ** 2 / ((x - x.mean()) ** 2).sum())


def stationary(x: np.ndarray, most: int = 10_000) -> int:
    """1 if the augmented Dickey-Fuller statistic with constant and trend, its lags chosen by AIC, is at the 5 % level; 1 where it can't be had."""
    x = x[-most:]
    d = np.diff(x)
    top = min(int(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 4)
    if top < 0 or x.std() < 1e-12:
        return 1
    best = (np.inf, 0.0)
    for p in range(top + 1):
        y = d[top:]
        cols = [x[top:-1], np.ones(len(y)), np.arange(len(y)), *[d[top - k : -k] for k in range(1, p + 1)]]
        q = np.column_stack(cols)
        e = _residual(y, q)
        s2 = (e @ e) / max(1, len(y) - q.shape[1])
        aic = len(y) * math.log(max((e @ e) / len(y), 1e-300)) + 2 * q.shape[1]
        beta = np.linalg.lstsq(q, y, rcond=None)[0][0]
        se = math.sqrt(max(s2 * np.linalg.pinv(q.T @ q)[0, 0], 1e-300))
        best = min(best, (aic, beta / se))
    n = len(x)
    return int(best[1] <= -3.4126 - 4.039 / n - 17.83 / n**2)


def loess(y: np.ndarray, width: int, ends: bool = False) -> np.ndarray:
    """Locally linear regression at the places of y (with ends, also at one place before and one after), tricube weights over the nearest width places."""
    n = len(y)
    q = min(width, n)
    at = np.arange(-1, n + 1) if ends else np.arange(n)
    left = np.clip(at - (q - 1) // 2, 0, n - q)
    reach = np.maximum(at - left, left + q - 1 - at) + max(0, width - n) // 2
    places = left[:, None] + np.arange(q)
    gap = np.abs(places - at[:, None])
    weight = np.where(gap <= 0.001 * reach[:, None], 1.0, np.where(gap <= 0.999 * reach[:, None], (1 - np.minimum(1.0, gap / np.maximum(reach, 1e-12)[:, None]) ** 3) ** 3, 0.0))
    weight = weight / weight.sum(axis=1, keepdims=True)
    centre = (weight * places).sum(axis=1)
    off = places - centre[:, None]
    spread = (weight * off * off).sum(axis=1)
    slope = np.where(np.sqrt(spread) > 0.001 * (n - 1), (at - centre) / np.where(spread > 0, spread, 1.0), 0.0)
    return (weight * (1 + slope[:, None] * off) * y[places]).sum(axis=1)


def _means(x: np.ndarray, width: int) -> np.ndarray:
    return np.convolve(x, np.ones(width) / width, mode="valid")


def stl(x: np.ndarray, m: int, seasonal: int, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Trend and season of period m, by the seasonal-trend decomposition of Cleveland and others (1990), without robustness weights."""
    n = len(x)
    trend_width = int(np.ceil(1.5 * m / (1 - 1.5 / seasonal)))
    trend_width += 1 - trend_width % 2
    low = m + 1 + m % 2
    trend, season = np.zeros(n), np.zeros(n)
    for _ in range(rounds):
        cycles = np.empty(n + 2 * m)
        for k in range(m):
            cycles[k::m] = loess((x - trend)[k::m], seasonal, ends=True)
        season = cycles[m : m + n] - loess(_means(_means(_means(cycles, m), m), 3), low)
        trend = loess(x - season, trend_width)
    return trend, season


def decompose(x: np.ndarray, periods: list[int]) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Trend, seasons by period (those of which two fit) and remainder: STL with a seasonal width of 13 for one period, else MSTL with widths of 11, 15, ... in two rounds; a moving average where no period fits."""
    usable = sorted({m for m in periods if m > 1 and 2 * m <= len(x)})
    if not usable:
        width = min(len(x), max(3, len(x) // 20) | 1)
        trend = np.convolve(np.pad(x, width // 2, mode="edge"), np.ones(width) / width, mode="valid")[: len(x)]
        return trend, {}, x - trend
    widths = [13] if len(usable) == 1 else [7 + 4 * (i + 1) for i in range(len(usable))]
    seasons, rest, trend = {m: np.zeros(len(x)) for m in usable}, x.astype(float), x
    for _ in range(min(2, len(usable))):
        for m, width in zip(usable, widths, strict=True):
            rest = rest + seasons[m]
            trend, seasons[m] = stl(rest, m, width)
            rest = rest - seasons[m]
    return trend, seasons, rest - trend


def decomposition_features(x: np.ndarray, periods: list[int]) -> dict[str, float]:
    n, m = len(x), max([p for p in periods if p > 1 and 2 * p <= len(x)], default=1)
    trend, seasons, e = decompose(x, periods)
    season = sum(seasons.values(), np.zeros(n))
    var = lambda v: float(np.var(v, ddof=1)) if n > 1 else 0.0
    ve, vx = var(e), var(x)
    strength = lambda whole: max(0.0, min(1.0, 1 - ve / var(whole))) if vx >= 1e-10 and var(whole) >= 1e-10 else 0.0
    d = (e - e.mean()) ** 2
    t = np.arange(n) - (n - 1) / 2
    q1 = t / math.sqrt((t * t).sum()) if n > 1 else t
    q2 = t * t - (t * t).mean()
    q2 = q2 / math.sqrt((q2 * q2).sum()) if n > 2 else q2
    acf, acf_d, acf_x, acf_dx = _acf(e), _acf(np.diff(e)), _acf(x), _acf(np.diff(x))
    k4 = ((e - e.mean()) ** 4).mean() / max(e.var() ** 2, 1e-300) - 3
    out = {
        "stationarity": float(stationary(x)), "x_entropy": spectral_entropy(x), "trend_strength": strength(x - season), "trend_stability": stability(trend, m), "trend_hurst": hurst(trend), "trend_nonlinearity": nonlinearity(trend),
        "spike": var((ve * (n - 1) - d) / (n - 2)) if n > 2 else float("nan"), "linearity": float(q1 @ trend), "curvature": -float(q2 @ trend),
        "x_acf1": acf_x[0], "x_acf10": (acf_x**2).sum(), "diff1_acf1": acf_dx[0], "diff1_acf10": (acf_dx**2).sum(), "e_acf1": acf[0], "e_acf10": (acf**2).sum(), "e_diff1_acf1": acf_d[0],
        "e_entropy": spectral_entropy(e), "e_arch_lm": arch(e), "e_kurtosis": k4, "e_shapiro_w": shapiro_w(e),
        "seasonal_strength": strength(x - trend) if seasons else float("nan"), "seasonal_corr": float("nan"), "seasonal_lumpiness": lumpiness(season, m) if seasons else float("nan"), "seasonal_entropy": spectral_entropy(season) if seasons else float("nan"),
    }
    if seasons and (c := n // m) >= 2:
        rows = season[: c * m].reshape(c, m)
        rows = rows - rows.mean(axis=1, keepdims=True)
        norm = np.linalg.norm(rows, axis=1)
        rows = rows[norm > 1e-12] / norm[norm > 1e-12, None]
        if len(rows) > 1:
            out["seasonal_corr"] = float(np.clip(((rows.sum(axis=0) ** 2).sum() - len(rows)) / (len(rows) * (len(rows) - 1)), -1, 1))
    return {k: float(v) for k, v in out.items()}


def heterogeneity(panel: DataFrame, value: str = "filled") -> DataFrame:
    """item, channel, location, scale, frequency and temporal_heterogeneity, their mean, of each series."""
    parts = temporal_heterogeneity(panel, value).join(extract(panel, [lambda x: {"frequency": frequency_heterogeneity(x)}], value), SERIES)
    return parts.select(*SERIES, "location", "scale", "frequency", ((F.col("location") + F.col("scale") + F.col("frequency")) / 3).alias("temporal_heterogeneity"))


def builtin(unit: str, periods: list[int]) -> list[Callable[[np.ndarray], dict[str, float]]]:
    return [lambda x: period_strengths(x, unit), lambda x: {"frequency_heterogeneity": frequency_heterogeneity(x)}, lambda x: decomposition_features(x, periods)]


def extract(panel: DataFrame, functions: list[Callable[[np.ndarray], dict[str, float]]], value: str = "filled") -> DataFrame:
    """A row for each series with the features of every function; all functions give the same names for any series."""
    names = [k for f in functions for k in f(np.sin(np.arange(64.0)))]
    schema = "item string, channel int, " + ", ".join(f"`{n}` double" for n in names)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("t")[value].to_numpy(dtype=float)
        row = {k: v for f in functions for k, v in f(x).items()}
        return pd.DataFrame([[*key, *(row.get(n, float("nan")) for n in names)]], columns=[*SERIES, *names])

    return panel.select(*SERIES, "t", value).groupBy(*SERIES).applyInPandas(run, schema)


def summary(features: DataFrame, names: list[str]) -> DataFrame:
    """feature, mean of the finite values, number of them; and of series."""
    rows = features.select(*SERIES, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in names])).alias("f")).select(*SERIES, "f.*")
    good = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    return rows.groupBy("feature").agg(F.avg(good).alias("mean"), F.count(good).alias("defined"), F.countDistinct(*SERIES).alias("series"))


def missing_only(series: DataFrame, done: DataFrame) -> DataFrame:
    """Series without features yet."""
    return series.join(done, SERIES, "left_anti")


def ranks(features: DataFrame, name: str) -> DataFrame:
    """Descending ranks, ties at the smaller."""
    return features.withColumn(f"{name}_rank", F.rank().over(W.orderBy(F.desc(name))))


__all__ = [n for n in dir() if not n.startswith("_")] + ["blocks"]
