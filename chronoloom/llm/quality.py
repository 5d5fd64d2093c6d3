"""Quality by compression: a text reads as whichever labelled text compresses it better.

Two zstandard dictionaries are trained, on good and on bad labelled text.  With g and b a text's compressed
sizes under them, its normalised difference is (b - g) / (b + g), that of the whole text and that of its worst
segment.  A text that repeats itself is small under both, and its difference says little; so the difference
between g and the size that good text of its length takes counts too, as the logarithm of g per byte and its
square (too small and too large are both unusual).  A logistic regression on labelled texts that the
dictionaries have not seen calibrates these four to a score; nothing else of a text enters it.

Fitting takes a bounded sample of the labelled rows: at most SAMPLE of each class, chosen by a hash of
the id and dealt into two folds.  Each fold's dictionaries (trained on the BYTES-byte slices at
hash-chosen places of its texts) measure the other's whole texts, in the cluster; only the features
come to the driver, for the calibration.  The model's own dictionaries are trained on both folds.
Scoring takes every text whole.

Defined results: null and empty texts have the features of no bytes and a score like any; rows whose
label is null or neither 0 nor 1 teach nothing; where a class has too few rows to fit, every score is
0.5; repeated rows are scored alike; other columns are ignored or passed on; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample for fitting: rows of each class, slices of a text, bytes of a slice.
SAMPLE, SLICES, BYTES = 3000, 2, 2048
DICTIONARY = 64 << 10
LEVEL = 3
#: Bytes of a segment, of which the worst one counts.
SEGMENT = 512
FEATURES = 4


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    spread: tuple[float, ...]


class _Compressors:
    def __init__(self, good: bytes, bad: bytes) -> None:
        trained = [zstandard.ZstdCompressionDict(x) for x in (good, bad)]
        for d in trained:
            d.precompute_compress(level=LEVEL)
        kept = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.good, self.bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **kept) for d in trained)

    def _difference(self, raw: bytes) -> tuple[int, int, float]:
        g, b = len(self.good.compress(raw)), len(self.bad.compress(raw))
        return g, b, (b - g) / (b + g)

    def features(self, text: str | None) -> list[float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        g, _, whole = self._difference(raw)
        worst = whole
        if len(raw) > SEGMENT:
            worst = min(self._difference(raw[k : k + SEGMENT])[2] for k in range(0, len(raw) - SEGMENT // 2, SEGMENT))
        size = math.log(g / max(1, len(raw)))
        return [whole, worst, size, size * size]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights, the intercept last, by Newton's method; both classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weigh = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + penalty + 1e-12 * np.eye(len(w)), x.T @ (weigh * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _slices(text: str, seed: int) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    rng = np.random.Generator(np.random.PCG64(seed))
    return [raw[k : k + BYTES] for k in (int(rng.integers(0, max(1, len(raw) - BYTES + 1))) for _ in range(SLICES if len(raw) > BYTES else 1))]


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: Column | None = None, sample: int = SAMPLE) -> Model | None:
    """A model from labels (id_col, label_col) whose rows held_out (a condition on id_col) leaves."""
    known = labels.select(id_col, label_col).where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if held_out is not None:
        known = known.where(~held_out)
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"), F.min(label_col).alias("least")).where("label = least")
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit(17))
    chosen = [known.where(F.col("label") == k).orderBy(order, id_col).limit(sample) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).select(id_col, "label", F.pmod(order, F.lit(2)).cast("int").alias("fold"))
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), id_col)  # at most 2 * sample ids

    seed = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(23)), F.lit(2**31))
    cut = F.udf(lambda text, s: [bytearray(x) for x in _slices(text or "", s)], "array<binary>")
    taught = rows.select("label", "fold", F.col(id_col).alias("id"), cut("text", seed).alias("slices")).collect()
    taught.sort(key=lambda r: (str(r.id), [bytes(s) for s in r.slices]))
    slices = {(k, fold): [bytes(s) for r in taught if (r.label, r.fold) == (k, fold) for s in r.slices] for k in (0, 1) for fold in (0, 1)}
    if min(map(len, slices.values())) < 8:
        return None
    folds = [(_dictionary(slices[1, fold]), _dictionary(slices[0, fold])) for fold in (0, 1)]
    good, bad = _dictionary(slices[1, 0] + slices[1, 1]), _dictionary(slices[0, 0] + slices[0, 1])

    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        by_fold = [_Compressors(*folds[1]), _Compressors(*folds[0])]  # each fold by the other's
        for texts, fold in batches:
            yield pd.Series([by_fold[k].features(t) for t, k in zip(texts, fold, strict=True)])

    seen = rows.select("label", F.col(id_col).alias("id"), measured("text", "fold").alias("x")).collect()
    seen.sort(key=lambda r: (str(r.id), r.x))
    x, y = np.array([r.x for r in seen]).reshape(len(seen), FEATURES), np.array([r.label for r in seen])
    if min((y == 0).sum(), (y == 1).sum()) < 4:
        return None
    centre, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    w = _logistic((x - centre) / spread, y)
    return Model(good, bad, tuple(w), tuple(centre), tuple(spread))


def score(model: Model | None, text: Column) -> Column:
    """The score of each text: 0 to 1, higher for good ones."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = _Compressors(model.good, model.bad)
        w, centre, spread = (np.array(v) for v in (model.weights, model.centre, model.spread))
        for batch in texts:
            x = np.array([c.features(t) for t in batch]).reshape(len(batch), FEATURES)
            yield pd.Series(1 / (1 + np.exp(-np.clip(((x - centre) / spread) @ w[:-1] + w[-1], -30, 30))))

    return scored(text.cast("string"))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows that never teach: the crc32 of the id's text is a multiple of folds."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def with_quality(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with columns score and predicted (1 at threshold or more)."""
    scored = docs.withColumn("score", score(model, F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
