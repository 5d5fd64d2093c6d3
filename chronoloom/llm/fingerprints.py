"""Bottom-k sketches of word shingles as document fingerprints.

A sketch holds the SIZE smallest distinct 64-bit shingle hashes, sorted, eight bytes each.  The sketch
of a union is the SIZE smallest of the parts' hashes, so sketches merge across parts in any order.
The SIZE smallest hashes of two sketches together are a uniform sample of the union of both sets:
the share found in both estimates their resemblance, the share of one side's containment; the SIZE-th
hash's place in the hash range gives the number of distinct shingles.  Sets of at most SIZE shingles
are held whole, and all figures on them are exact.

Defined results: a null or blank text has an empty sketch; two empty sketches are alike (1.0), an
empty and another are not (0.0); an empty set is contained in any; texts shorter than a shingle are
one shingle; texts of equal words have equal sketches; other columns are ignored; no rows give no
rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_by_key
from .shingles import U, shingle_sets

SIZE, WORDS = 128, 5
#: The lowest id stands for a null one.
_LOWEST = -(2**63)


def sketch(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    return np.unique(hashes)[:size]


def merge(sketches: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    return np.unique(np.concatenate(sketches))[:size] if sketches else np.zeros(0, U)


def _sample(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    union = np.unique(np.concatenate([a, b]))[:size]
    return union, np.isin(union, a, assume_unique=True), np.isin(union, b, assume_unique=True)


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """|A & B| / |A | B|."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.sort(np.concatenate([a, b]))
    twice = union[1:] == union[:-1]
    distinct = np.concatenate([[True], ~twice])
    place = np.cumsum(distinct)
    return float((twice & (place[1:] <= size)).sum() / min(size, place[-1]))


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """|A & B| / |A|."""
    if not len(a):
        return 1.0
    _, in_a, in_b = _sample(a, b, size)
    return float((in_a & in_b).sum() / in_a.sum()) if in_a.any() else 0.0


def distinct(a: np.ndarray, size: int = SIZE) -> float:
    """The number of distinct shingles."""
    return float(len(a)) if len(a) < size else (size - 1) / ((int(a[-1]) + 1) / 2.0**64)


def pack(a: np.ndarray) -> bytes:
    return a.astype(">u8").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u8").astype(U)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, size: int = SIZE) -> DataFrame:
    """(id_col, sketch, n_distinct) for each row."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [s[:size] for s in shingle_sets(batch.column(1), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(s) for s in made], pa.binary()), pa.array([distinct(s, size) for s in made], pa.float64())], names=[id_col, "sketch", "n_distinct"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, sketch binary, n_distinct double")


def merged(parts: DataFrame, group: str, size: int = SIZE) -> DataFrame:
    """(group, sketch, n_distinct): one sketch for each group, merged within input tasks first, so that a group of any size reaches its last task as one sketch from each."""
    kinds = dict(parts.dtypes)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = unpack(raw or b"")
                held[key] = merge([held[key], own], size) if key in held else own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), type=kind_of(kinds[group])), pa.array([pack(s) for s in held.values()], pa.binary())], names=[group, "sketch"])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in rows_by_key(batches, 1):
            one = merge([unpack(x) for x in rows.column(1).to_pylist()], size)
            yield pa.RecordBatch.from_arrays([rows.column(0).combine_chunks().slice(0, 1), pa.array([pack(one)], pa.binary()), pa.array([distinct(one, size)], pa.float64())], names=[group, "sketch", "n_distinct"])

    kind_of = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}.__getitem__
    key = f"`{group}` {kinds[group]}, sketch binary"
    partial = parts.select(group, "sketch").mapInArrow(near, key)
    return partial.repartition(group).sortWithinPartitions(group).mapInArrow(far, f"{key}, n_distinct double")


def _bucket(bounds: list[int], key) -> F.Column:
    """The index of the last bound not above key, found in two steps of about the root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    at_most = lambda array: F.size(F.filter(array, lambda x: x <= key))
    coarse = F.greatest(at_most(F.lit(bounds[::step])) - 1, F.lit(0)) * step
    return coarse + F.greatest(at_most(F.slice(F.lit(bounds), coarse + 1, F.lit(step))) - 1, F.lit(0))


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows (bucket, ghost, id, text) of (doc_id, text), in runs of ascending ids that each end with the next run's first rows.

    The runs' bounds are quantiles of the ids, a few for each shuffle partition; rows whose id is a
    bound also go to the run before, as ghosts.  Texts are shuffled once, and no task gets more
    than its runs.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = 8 * parts
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("id"), "doc_id", F.col("text").cast("string").alias("text"))
    shares = [i / runs for i in range(runs)]
    row = keyed.agg(F.min("id").alias("low"), F.percentile_approx("id", shares, 20 * runs).alias("cuts")).first()
    bounds = sorted({row.low, *(row.cuts or [])} - {None}) or [0]
    own = _bucket(bounds, F.col("id")).cast("int")
    first = F.col("id") == F.element_at(F.lit(bounds), own + 1)
    home = F.struct(own.alias("bucket"), F.lit(0).alias("ghost"))
    away = F.struct(F.pmod(own - 1, F.lit(len(bounds))).cast("int").alias("bucket"), F.lit(1).alias("ghost"))
    dealt = keyed.withColumn("to", F.explode(F.when(first, F.array(home, away)).otherwise(F.array(home))))
    return dealt.select("to.bucket", "to.ghost", "id", "doc_id", "text").repartition(parts, "bucket").sortWithinPartitions("bucket", "ghost", "id", "text")


def edited_fingerprints(docs: DataFrame, n: int = WORDS, size: int = SIZE) -> DataFrame:
    """Each text's fingerprint, and that of its edited text (its last quarter of code points replaced by the start of the next document), with their likeness, the share of its shingles that the edited text holds, and their number.

    Documents follow in ascending doc_id, a null one first, equal ids by text; the first follows the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(_followed(batches)):
            texts = [r[1] for r in rows]
            edited = []
            for _, text, after in rows:
                k = len(text) // 4
                edited.append(text[: len(text) - k] + after[:k])
            own, new, following = (list(s[:size] for s in shingle_sets(pa.array(x, pa.large_string()), n)) for x in (texts, edited, [r[2] for r in rows]))
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_in_edited", "distinct_shingles"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([base64.b64encode(pack(s)).decode() for s in own], pa.string()),
                    pa.array([base64.b64encode(pack(s)).decode() for s in new], pa.string()),
                    pa.array([resemblance(a, b, size) for a, b in zip(own, new, strict=True)], pa.float64()),
                    pa.array([resemblance(a, b, size) for a, b in zip(own, following, strict=True)], pa.float64()),
                    pa.array([containment(a, b, size) for a, b in zip(own, new, strict=True)], pa.float64()),
                    pa.array([distinct(a, size) for a in own], pa.float64()),
                ],
                names=names,
            )

    return with_successors(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_edited double, distinct_shingles double")


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """(doc_id, text, next text) for the rows that are no ghosts, out of sorted runs."""
    held = None
    for batch in batches:
        for bucket, ghost, _, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if held and held[0] == bucket:
                yield held[1], held[2], text
                held = None
            if not ghost:
                held = (bucket, doc_id, text)
    if held:
        raise AssertionError("a run without its successor")


def _chunks(rows: Iterator[tuple], most: int = 1024, chars: int = 4 << 20) -> Iterator[list[tuple]]:
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += len(row[1])
        if len(some) >= most or held >= chars:
            yield some
            some, held = [], 0
    if some:
        yield some
