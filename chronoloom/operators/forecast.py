"""Forecasters as a slot of Python code over windows, and what is run around them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Why a row has no adapted forecast.
REASONS = {0: "ok", 1: "too_few_neighbours", 2: "target_not_finite", 3: "vanilla_not_finite", 4: "covariate_not_finite", 5: "neighbour_not_finite", 6: "scale_not_defined"}


class Forecaster(ABC):
    """forecast takes contexts (rows, length), NaN where missing, and gives (rows, horizon)."""

    retrieval = False
    covariates = False

    @abstractmethod
    def forecast(self, context: np.ndarray, horizon: int, retrieved: np.ndarray | None = None) -> np.ndarray: ...

    def represent(self, context: np.ndarray) -> np.ndarray:
        m = np.nanmean(context, axis=1, keepdims=True)
        return (context - m) / np.maximum(np.nanstd(context, axis=1, keepdims=True), 1e-8)


def fill(context: np.ndarray) -> np.ndarray:
    """Forward fill; the first observed value before it; 0 where there is none."""
    frame = pd.DataFrame(context.T).ffill().bfill().fillna(0.0)
    return frame.to_numpy().T


class SeasonalNaive(Forecaster):
    def __init__(self, m: int) -> None:
        self.m = m

    def forecast(self, context: np.ndarray, horizon: int, retrieved: np.ndarray | None = None) -> np.ndarray:
        filled = fill(context)
        season = filled[:, -min(self.m, filled.shape[1]) :]
        return np.tile(season, (1, -(-horizon // season.shape[1])))[:, :horizon]


class Drift(Forecaster):
    def forecast(self, context: np.ndarray, horizon: int, retrieved: np.ndarray | None = None) -> np.ndarray:
        filled = fill(context)
        slope = (filled[:, -1] - filled[:, 0]) / max(1, filled.shape[1] - 1)
        return filled[:, -1:] + slope[:, None] * np.arange(1, horizon + 1)


class RetrievalMean(Forecaster):
    """The mean of retrieved futures; the seasonal-naive forecast where there are none."""

    retrieval = True

    def __init__(self, m: int) -> None:
        self.base = SeasonalNaive(m)

    def forecast(self, context: np.ndarray, horizon: int, retrieved: np.ndarray | None = None) -> np.ndarray:
        plain = self.base.forecast(context, horizon)
        return plain if retrieved is None or not retrieved.shape[1] else retrieved[:, :, -horizon:].mean(axis=1)


REGISTRY: dict[str, Callable[..., Forecaster]] = {"seasonal_naive": SeasonalNaive, "drift": Drift, "retrieval_mean": RetrievalMean}


def forecast(windows: DataFrame, make: Callable[[], Forecaster], horizon: int, keys: list[str], retrieved: str | None = None) -> DataFrame:
    """keys and yhat, an array, for windows with a context array (and an array of neighbours' arrays).

    The model is made once in each worker; a batch's rows go to it by equal context length (and number
    of neighbours).
    """
    fields = {f.name: f.dataType.simpleString() for f in windows.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", yhat array<double>"
    columns = [*keys, "context"] + ([retrieved] if retrieved else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for rows in batches:
            near = [list(x) if x is not None else [] for x in rows[retrieved]] if retrieved else [[]] * len(rows)
            shape = [(len(c), len(r)) for c, r in zip(rows["context"], near, strict=True)]
            out: list = [None] * len(rows)
            for s in sorted(set(shape)):
                at = [i for i, x in enumerate(shape) if x == s]
                context = np.array([[np.nan if v is None else v for v in rows["context"].iloc[i]] for i in at], dtype=float).reshape(len(at), s[0])
                extra = np.array([[list(n) for n in near[i]] for i in at], dtype=float) if s[1] else None
                made = model.forecast(context, horizon, extra)
                if made.shape != (len(at), horizon):
                    raise ValueError(f"the forecast has shape {made.shape}")
                for i, row in zip(at, made, strict=True):
                    out[i] = row.tolist()
            yield rows[keys].assign(yhat=out)

    return windows.select(*columns).mapInPandas(run, schema)


def long_form(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    return forecasts.select(*keys, F.posexplode("yhat").alias("h", "yhat"))


def eligibility(rows: DataFrame, k: int) -> DataFrame:
    """rows with reason, a code of REASONS; rows has neighbours, target_finite, vanilla_finite, covariate_finite, neighbour_finite (booleans) and scale."""
    code = F.when(F.col("neighbours") < k, 1).when(~F.col("target_finite"), 2).when(~F.col("vanilla_finite"), 3).when(~F.col("covariate_finite"), 4).when(~F.col("neighbour_finite"), 5)
    return rows.withColumn("reason", code.when(F.col("scale").isNull() | (F.col("scale") <= 0), 6).otherwise(0))


def rollout(context: np.ndarray, step: Callable[[np.ndarray, int], np.ndarray], horizon: int, chunk: int = 64) -> np.ndarray:
    """A long forecast in chunks, each from the context and what was forecast before."""
    made = np.zeros((len(context), 0))
    while made.shape[1] < horizon:
        whole = np.hstack([context, made])[:, -context.shape[1] :]
        made = np.hstack([made, step(whole, min(chunk, horizon - made.shape[1]))])
    return made


def cached(requests: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests that the cache holds, with its values, and distinct ones that it lacks."""
    distinct = requests.select(*keys).distinct()
    return requests.join(cache, keys), distinct.join(cache, keys, "left_anti")


def isolated(tasks: list, run: Callable, fallback: Callable) -> dict:
    """The result of run for each task; fallback's where it fails, with the error."""
    results = {}
    for task in tasks:
        results[task] = ("fallback", fallback(task), None)
        try:
            results[task] = ("ok", run(task), None)
        except Exception as error:  # one task must not end the others
            results[task] = ("fallback", results[task][1], repr(error))
    return results
