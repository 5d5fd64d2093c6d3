"""Exact top-k inner products by pivot-table elimination.

An inner product falls as the distance of its two vectors grows: 2 q.x = |q|^2 + |x|^2 - d^2.  Distances
of all vectors to PIVOTS pivots are computed once.  They bound d(q, x) from below, and so q.x from above:
by the largest |d(q, p) - d(x, p)| over the pivots for whole blocks, and for single candidates by the
distance of the apexes of both over the simplex of the pivots (n-simplex projection: the places that the
distances fix in the pivots' span, and the heights above it), which no bound from the same distances exceeds.

Candidates are dealt by their nearest pivot into blocks of about BLOCK and shuffled once.  A first pass
takes each query against about FIRST candidates of its own cell, for a k-th best score to start from.  The
second sends the queries, which are fewer, in parts of about QUERIES to every block whose bound, from the
ranges of its distances to each pivot and its largest norm, can still reach the least of those scores.  A
task holds one block and a batch of queries; a query's candidates are evaluated in the order of their
bounds, STEP at a time, until the next bound is below its k-th score.  Bounds are widened by ROUNDING;
scores are integers, computed exactly: in double precision where no product can pass 2^53, else in whole
numbers of any size.

Defined results: vectors that are null, hold null or non-finite components or have another length than
most take no part; a query with fewer candidates has fewer rows; ties go to the smaller id; rows that
repeat an id and its vector count once, those of one id with different vectors are each a candidate and,
if asked, a query; a component or a score among the best that no long can hold is an error; other columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, salted_join

PIVOTS, BLOCK, QUERIES, FIRST, STEP = 48, 4096, 256, 256, 64
#: Queries that one task takes against a block, about.
ASKED = 16384
ROUNDING = 1e-6


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, v): floor(scale * x), x as double, for the vectors that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = F.col(vector_col).isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.col(vector_col)).where(whole)
    return kept.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")).dropDuplicates(["id", "v"])


def _matrix(column: pa.ChunkedArray | pa.Array, dtype=np.int64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(n, -1) if n else np.zeros((0, 0), dtype)


def _lifted(v: np.ndarray, most: float | None) -> np.ndarray:
    """Candidates with their further component, or queries (most is None) with 0."""
    x = v.astype(np.float64)
    return np.hstack([x, np.zeros((len(x), 1)) if most is None else np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def choose_pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those chosen."""
    chosen = [0]
    gap = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(number, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(sample, sample[chosen[-1] :][:1])[:, 0])
    return sample[chosen]


class Apexes:
    """Places over the simplex of the pivots, from distances to them: coordinates in their span, from the first pivot, and the height above it."""

    def __init__(self, pivots: np.ndarray) -> None:
        edges = pivots[1:] - pivots[0]
        u, size, _ = np.linalg.svd(edges, full_matrices=False)
        kept = size > 1e-9 * max(size.max(initial=0.0), 1e-300)
        self.square, self.turn = (edges * edges).sum(axis=1), u[:, kept] / size[kept]

    def of(self, far: np.ndarray) -> np.ndarray:
        near = far * far
        flat = (near[:, :1] - near[:, 1:] + self.square) / 2 @ self.turn
        return np.hstack([flat, np.sqrt(np.maximum(0.0, near[:, :1] - (flat * flat).sum(axis=1, keepdims=True)))])


def products_of(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0.0)) * float(np.abs(q.astype(np.float64)).sum())
    if most < 2**53:
        return np.rint(x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    return x.astype(object) @ q.astype(object)


def best_of(q: np.ndarray, q_ids: np.ndarray, q_far: np.ndarray, floor: np.ndarray, x: np.ndarray, ids: np.ndarray, far: np.ndarray, most: float | np.ndarray, k: int, simplex: Apexes | None = None, own: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list, int]:
    """(query id, id, score) of each query's k best in one block at or above its floor, and how many products were computed.

    far: distances to the pivots; floor: a score that the query's k-th best has at least; most: the squared norms
    of the candidates (as they were measured: the lifted ones' is one number); own: what tells the rows of queries
    and candidates apart, if not their ids.  query ids are given as places in q if own is.
    """
    found, products = [], 0
    square = (q.astype(np.float64) ** 2).sum(axis=1)
    q_own, c_own = own if own is not None else (q_ids, ids)
    if simplex is not None:
        a, b = simplex.of(q_far), simplex.of(far)
        near = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
        slack = ROUNDING * (square[:, None] + most + (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :])
        uppers = (square[:, None] + most - near) / 2 + slack
        asking = np.flatnonzero((uppers >= floor.astype(np.float64)[:, None]).any(axis=1))
    else:
        asking = range(len(q))
    for i in asking:
        if simplex is not None:
            upper = uppers[i]
        else:
            bound = np.abs(far - q_far[i]).max(axis=1)
            upper = (square[i] + most - bound**2) / 2 + ROUNDING * (square[i] + most)
        least = floor[i]
        open_ = np.flatnonzero((upper >= least) & (c_own != q_own[i]))
        open_ = open_[np.argsort(-upper[open_], kind="stable")]
        top: list[tuple] = []
        for at in range(0, len(open_), STEP):
            some = open_[at : at + STEP]
            if upper[some[0]] < least:
                break
            exact = products_of(x[some], q[i])
            products += len(some)
            top = sorted(top + [(-int(s), int(c)) for s, c in zip(exact, ids[some], strict=True)])[:k]
            if len(top) == k:
                least = max(least, -top[-1][0])
        found += [(int(i) if own is not None else int(q_ids[i]), c, -s) for s, c in top if -s >= floor[i]]
    return found, products


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors (id, v) with v of integers; is_query is a condition on id."""
    spark = vectors.sparkSession
    tables = Tables(spark)
    result = "query_id long, rank int, vec_id long, score long"
    whole = tables.keep(vectors.select("id", "v"), "vectors")
    sizes = whole.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None or sizes.size == 0:
        return spark.createDataFrame([], result)
    whole = whole.where(F.size("v") == sizes.size)
    sample = whole.orderBy(F.xxhash64("id", F.lit(3)), "id", "v").limit(2048).collect()  # a bounded sample to choose pivots from
    anchors = choose_pivots(np.array(sorted(r.v for r in sample)).astype(np.float64), pivots)
    simplex = Apexes(anchors)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2)).astype(np.float64)
            far = _distances(v, anchors) if len(v) else np.zeros((0, len(anchors)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * far.shape[1], pa.int32()), pa.array(far.ravel(), pa.float64()))
            norm = (v * v).sum(axis=1) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(norm, pa.float64()), pa.array(far.argmin(axis=1) if len(far) else np.zeros(0), pa.int32())], names=["row", "id", "v", "far", "norm", "cell"])

    # Rows are numbered as they are written; every later step reads the numbers.
    numbered = whole.select(F.monotonically_increasing_id().alias("row"), "id", "v")
    table = tables.keep(numbered.mapInArrow(measured, "row long, id long, v array<long>, far array<double>, norm double, cell int"), "pivots")
    tables.drop("vectors")
    counted = {r["cell"]: r["count"] for r in table.groupBy("cell").count().collect()}  # a row for each pivot at most

    asking = table.where(is_query)
    asked = {r["cell"]: r["count"] for r in asking.groupBy("cell").count().collect()}
    if not asked:
        return spark.createDataFrame([], result)

    def parts(of: dict[int, int], size: int) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for c, n in of.items() for x in (c, -(-n // size))])[F.col("cell")], F.lit(1))

    def part(number: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64("row", F.lit(seed)), number).cast("int")

    def each(number: Column | int) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.lit(number) if isinstance(number, int) else number) - 1))

    candidates = table.withColumn("part", part(parts(counted, block), 11))

    def against(rows: DataFrame) -> DataFrame:
        """rows (cell, part, turn, side, row, id, v, floor), candidates (side 0) before queries: each query's best in the block."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, ready = None, [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                places = np.stack([batch.column(i).to_numpy() for i in range(4)])
                cuts = np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0)) + 1
                for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                    *block_of, side = (int(x) for x in places[:, a])
                    if key != block_of:
                        key, held, ready = block_of, [], None
                    part_of = batch.slice(a, b - a)
                    row, ids, v = part_of.column(4).to_numpy(), part_of.column(5).to_numpy(), _matrix(part_of.column(6))
                    if side == 0:
                        held.append((row, ids, v))
                        continue
                    if not held:
                        continue
                    if ready is None:
                        c_row, c_ids, c = (np.concatenate(z) for z in zip(*held, strict=True))
                        cf = c.astype(np.float64)
                        ready = (c_row, c_ids, c, _distances(cf, anchors), (cf * cf).sum(axis=1))
                    c_row, c_ids, c, c_far, norms = ready
                    floor = np.array([np.iinfo(np.int64).min if f is None else f for f in part_of.column(7).to_pylist()], dtype=np.int64)
                    for at in range(0, len(row), QUERIES):
                        some = slice(at, at + QUERIES)
                        found, _ = best_of(v[some], ids[some], _distances(v[some].astype(np.float64), anchors), floor[some], c, c_ids, c_far, norms, k, simplex, (row[some], c_row))
                        if found:
                            i, vec, score = (list(z) for z in zip(*found, strict=True))
                            yield pa.RecordBatch.from_arrays([pa.array(row[some][i]), pa.array(ids[some][i]), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], names=["row", "query_id", "vec_id", "score"])

        return rows.repartition("cell", "part", "turn").sortWithinPartitions("cell", "part", "turn", "side").mapInArrow(run, "row long, query_id long, vec_id long, score long")

    def rows(frame: DataFrame, side: int, floor: Column) -> DataFrame:
        return frame.select("cell", "part", "turn", F.lit(side).alias("side"), "row", "id", "v", floor.cast("long").alias("floor"))

    none = F.lit(None)
    ranked = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    turns = parts(asked, ASKED)
    near = table.withColumn("part", part(parts(counted, FIRST), 5)).where("part = 0").withColumn("turn", each(turns))
    first = against(rows(near, 0, none).unionByName(rows(asking.withColumns({"part": F.lit(0), "turn": part(turns, 17)}), 1, none)))
    first = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    floors = first.groupBy("row").agg(F.min("score").alias("least"), F.count("*").alias("n")).select("row", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    most = -(-sum(asked.values()) // ASKED)
    queries = asking.select("row", "id", "v", "far", "norm", F.col("cell").alias("qc"), part(parts(asked, QUERIES), 13).alias("qp"))
    queries = tables.keep(queries.join(floors, "row", "left"), "queries")

    # The blocks that the bound of some query of a part can reach: a row for each part and block.
    span = lambda f: F.array(*[f(F.element_at("far", i + 1)) for i in range(len(anchors))])
    ranges = candidates.groupBy("cell", "part").agg(span(F.min).alias("near"), span(F.max).alias("far"), F.max("norm").alias("most"))
    ranges = tables.keep(ranges, "ranges")
    reach = queries.groupBy("qc", "qp").agg(span(F.min).alias("q_near"), span(F.max).alias("q_far"), F.min(F.coalesce("floor", F.lit(-(2**62)))).alias("floor"), F.max("norm").alias("norm"))
    every = reach.withColumn("cell", F.explode(F.array(*map(F.lit, sorted(counted))))).withColumn("_spread", F.hash("qc", "qp"))
    every = salted_join(every, ranges, ["cell"], "_spread", "inner")
    gap = F.array_max(F.transform(F.arrays_zip("q_near", "q_far", "near", "far"), lambda z: F.greatest(z["near"] - z["q_far"], z["q_near"] - z["far"], F.lit(0.0))))
    bound = F.least((F.col("norm") + F.col("most") - gap * gap) / 2, F.sqrt(F.col("norm") * F.col("most"))) + ROUNDING * (F.col("norm") + F.col("most"))
    open_ = every.where(bound >= F.col("floor")).select("qc", "qp", "cell", "part")
    sent = queries.select("qc", "qp", "row", "id", "v", "floor").join(open_, ["qc", "qp"]).withColumn("turn", F.pmod(F.xxhash64("qc", "qp"), F.lit(most)).cast("int"))
    found = against(rows(candidates.withColumn("turn", each(most)), 0, none).unionByName(rows(sent, 1, F.col("floor"))))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
