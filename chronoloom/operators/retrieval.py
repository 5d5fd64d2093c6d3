"""Chronological candidate joins and exact nearest neighbours over window representations.

References have ref_id, item, channel, tick and rep (an array of doubles, null where missing).
Candidates of a query are those of equal residue of the tick by the stride, an equi join that deals
both sides, filtered by the time at which a candidate's future is known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import distance

SCOPES = ("same_series", "other_series", "all")


def _scoped(scope: str) -> Column:
    same = (F.col("q.item") == F.col("d.item")) & (F.col("q.channel") == F.col("d.channel"))
    if scope not in SCOPES:
        raise ValueError(f"no such scope: {scope}")
    return {"same_series": same, "other_series": ~same, "all": F.lit(True)}[scope]


def eligible(queries: DataFrame, store: DataFrame, stride: int, horizon: int, scope: str = "all", ends: DataFrame | None = None, period: int | None = None) -> DataFrame:
    """Pairs (query_id, ref_id, q_rep, d_rep): in phase by the stride, and with a future that ends by the query; with ends (item, end_tick), also by the fixed end of the candidate's item, rounded down into phase by the period."""
    if ends is None:
        q, d = (x.withColumn("_phase", F.pmod("tick", F.lit(stride))) for x in (queries, store))
        joined = q.alias("q").join(d.alias("d"), F.col("q._phase") == F.col("d._phase"))
        allowed = F.col("d.tick") + horizon <= F.col("q.tick")
    else:
        if not period:
            raise ValueError("fixed ends need a period")
        q, d = (x.withColumn("_phase", F.pmod("tick", F.lit(period))) for x in (queries, store.join(ends, "item")))
        joined = q.alias("q").join(d.alias("d"), F.col("q._phase") == F.col("d._phase"))
        last = F.least(F.col("q.tick") - horizon, F.col("d.end_tick"))
        last = last - F.pmod(last - F.col("q.tick"), F.lit(period))
        allowed = (F.col("d.tick") <= last) & (F.pmod(last - F.col("d.tick"), F.lit(stride)) == 0)
    pairs = joined.where(allowed & _scoped(scope))
    return pairs.select(F.col("q.ref_id").alias("query_id"), F.col("d.ref_id").alias("ref_id"), F.col("q.rep").alias("q_rep"), F.col("d.rep").alias("d_rep"))


def nearest(pairs: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """query_id, rank, ref_id, distance: the k nearest comparable candidates, ties to the smaller ref_id."""
    scored = pairs.select("query_id", "ref_id", distance(F.col("q_rep"), F.col("d_rep"), metric).alias("distance")).where("distance is not null")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "ref_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "ref_id", "distance")


#: References of a block and queries of a batch; a task holds one of each.  Of fewer where each pair is a row.
BLOCK, BATCH = 4096, 512
PAIRS = 512, 32


def _vectors(column: pa.Array) -> np.ndarray:
    """Arrays of equal length as rows, NaN where a value is missing."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def masked_distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean", least_overlap: float = 0.8) -> np.ndarray:
    """Distances of all pairs of rows over the places where both have a value; NaN where fewer than the least share have."""
    has_a, has_b = ~np.isnan(a), ~np.isnan(b)
    x, y, n = np.where(has_a, a, 0.0), np.where(has_b, b, 0.0), a.shape[1]
    both = has_a.astype(float) @ has_b.T.astype(float)
    left, right, dot = (x * x) @ has_b.T, has_a @ (y * y).T, x @ y.T
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "euclidean":
            found = np.sqrt(np.maximum(left + right - 2 * dot, 0.0) * n / both)
        elif metric == "cosine":
            norm = np.sqrt(left) * np.sqrt(right)
            found = np.where(norm > 1e-8, 1 - np.clip(dot / norm, -1.0, 1.0), np.nan)
        else:
            raise ValueError(f"no such metric: {metric}")
    return np.where(both >= max(1, np.ceil(n * least_overlap)), found, np.nan)


def direct_distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean", least_overlap: float = 0.8) -> np.ndarray:
    """masked_distances from the differences themselves, so that small ones keep their digits; it holds a row for each pair."""
    if metric != "euclidean":
        return masked_distances(a, b, metric, least_overlap)
    gap, n = a[:, None, :] - b[None, :, :], a.shape[1]
    both = (~np.isnan(gap)).sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        found = np.sqrt(np.nansum(gap * gap, axis=2) * n / both)
    return np.where(both >= max(1, np.ceil(n * least_overlap)), found, np.nan)


def _scope_mask(scope: str, names: np.ndarray, others: np.ndarray) -> np.ndarray | bool:
    return True if scope == "all" else (names[:, None] == others[None, :]) == (scope == "same_series")


def _by_blocks(queries: DataFrame, store: DataFrame, stride: int, scope: str, work: Callable[[tuple, tuple], pa.RecordBatch | None], schema: str, size: int, batch: int) -> DataFrame:
    """What work makes of each block of references and batch of queries in phase with it, both being ref_ids (Arrow), series, ticks, vectors.

    Each phase's references are dealt into blocks of about size, as many as its count asks for, and go to
    one task each; queries, which are fewer, go to every block of their phase.
    """
    if scope not in SCOPES:
        raise ValueError(f"no such scope: {scope}")
    phase = F.pmod("tick", F.lit(stride)).cast("long")
    series = F.concat_ws("/", F.col("item").cast("string"), F.col("channel").cast("string"))
    q, d = (x.select(phase.alias("phase"), "ref_id", series.alias("series"), F.col("tick").cast("long").alias("tick"), "rep") for x in (queries, store))
    sizes = d.groupBy("phase").agg(F.ceil(F.count("*") / size).cast("long").alias("parts"))  # a row for each phase
    d = d.join(F.broadcast(sizes), "phase").withColumn("part", F.pmod(F.xxhash64("ref_id"), F.col("parts"))).withColumn("side", F.lit(0))
    q = q.join(F.broadcast(sizes), "phase").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("side", F.lit(1))
    columns = ["phase", "part", "side", "ref_id", "series", "tick", "rep"]
    rows = q.select(*columns).unionByName(d.select(*columns)).repartition("phase", "part").sortWithinPartitions("phase", "part", "side")

    def taken(rows: pa.RecordBatch | pa.Table) -> tuple:
        whole = (lambda c: c.combine_chunks()) if isinstance(rows, pa.Table) else (lambda c: c)
        return whole(rows.column(3)), np.array(rows.column(4).to_pylist()), rows.column(5).to_numpy(), _vectors(whole(rows.column(6)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for rows in batches:
            if not rows.num_rows:
                continue
            places = np.stack([rows.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, rows.num_rows], strict=True):
                *where, side = (int(x) for x in places[:, a])
                if key != where:
                    key, held, block = where, [], None
                part = rows.slice(a, b - a)
                if side == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if block is None:
                    block = taken(pa.Table.from_batches(held))
                for at in range(0, part.num_rows, batch):
                    found = work(taken(part.slice(at, batch)), block)
                    if found is not None and found.num_rows:
                        yield found

    return rows.mapInArrow(run, schema)


def nearest_blocks(queries: DataFrame, store: DataFrame, stride: int, horizon: int, k: int, scope: str = "all", metric: str = "euclidean") -> DataFrame:
    """query_id, rank, ref_id, distance: what nearest gives on the pairs of eligible, without making them.

    A task takes a block's distances by matrix products and keeps k of each query; those near the k-th are
    worked out again one by one, so that ties are those of equal vectors.
    """

    def best(asked: tuple, block: tuple) -> pa.RecordBatch | None:
        ids, names, ticks, reps = asked
        far = masked_distances(reps, block[3], metric)
        allowed = (block[2][None, :] + horizon <= ticks[:, None]) & _scope_mask(scope, names, block[1])
        far = np.where(allowed & ~np.isnan(far), far, np.inf)
        out = []
        for i, row in enumerate(far):
            edge = np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
            some = np.flatnonzero(row <= (edge + 1e-6 * (1 + edge) if np.isfinite(edge) else np.finfo(float).max))
            exact = sorted((_exact(reps[i], block[3][j], metric), block[0][int(j)].as_py()) for j in some)
            out += [(ids[i].as_py(), ref, float(x)) for x, ref in exact[:k]]
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.float64()), strict=True)], names=["query_id", "ref_id", "distance"])

    found = _by_blocks(queries, store, stride, scope, best, "query_id string, ref_id string, distance double", BLOCK, BATCH)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "ref_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "ref_id", "distance")


def pair_distances(queries: DataFrame, store: DataFrame, stride: int, horizon: int, metrics: tuple[str, ...] = ("euclidean",), scope: str = "all") -> DataFrame:
    """query_id, ref_id and a column for each metric: the distances of all pairs of eligible, null where too few places are shared, without a row of vectors for each pair."""

    def all_of(asked: tuple, block: tuple) -> pa.RecordBatch | None:
        allowed = (block[2][None, :] + horizon <= asked[2][:, None]) & _scope_mask(scope, asked[1], block[1])
        i, j = np.nonzero(allowed)
        far = [pa.array(direct_distances(asked[3], block[3], m)[i, j], from_pandas=True) for m in metrics]
        return pa.RecordBatch.from_arrays([asked[0].take(pa.array(i)), block[0].take(pa.array(j)), *far], names=["query_id", "ref_id", *metrics])

    schema = "query_id string, ref_id string, " + ", ".join(f"{m} double" for m in metrics)
    return _by_blocks(queries, store, stride, scope, all_of, schema, *PAIRS)


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> float:
    both = ~np.isnan(a) & ~np.isnan(b)
    x, y = a[both], b[both]
    if metric == "euclidean":
        return float(np.sqrt(((x - y) ** 2).sum() * len(a) / both.sum()))
    return float(1 - np.clip((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())), -1.0, 1.0))


def scope_counts(queries: DataFrame, store: DataFrame, stride: int, horizon: int) -> DataFrame:
    """query_id, eligible, same_series, other_series: candidates of each query by scope, in one join without vectors; queries without any have no row."""
    phase = F.pmod("tick", F.lit(stride))
    q, d = (x.select("ref_id", "item", "channel", "tick", phase.alias("_phase")) for x in (queries, store))
    per = d.groupBy("_phase", "item", "channel", "tick").agg(F.count("*").alias("n"))
    joined = q.alias("q").join(per.alias("d"), (F.col("q._phase") == F.col("d._phase")) & (F.col("d.tick") + horizon <= F.col("q.tick")))
    same = (F.col("q.item") == F.col("d.item")) & (F.col("q.channel") == F.col("d.channel"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("d.n"))), F.lit(0))
    return joined.groupBy(F.col("q.ref_id").alias("query_id")).agg(F.sum("d.n").alias("eligible"), total(same).alias("same_series"), total(~same).alias("other_series"))


def coverage(queries: DataFrame, store: DataFrame, stride: int, horizon: int, scope: str = "all", metric: str = "euclidean") -> DataFrame:
    """query_id, eligible, comparable: how many candidates a query has, and how many have a distance to it; counted in blocks, without a row for each pair."""
    if metric == "euclidean":  # where there are values is all that counts
        queries, store = (x.withColumn("rep", F.transform("rep", lambda v: F.when(v.isNotNull(), F.lit(1.0)))) for x in (queries, store))

    def count(asked: tuple, block: tuple) -> pa.RecordBatch:
        allowed = (block[2][None, :] + horizon <= asked[2][:, None]) & _scope_mask(scope, asked[1], block[1])
        if metric == "euclidean":
            has = [(~np.isnan(x)).astype(np.float32) for x in (asked[3], block[3])]
            comparable = has[0] @ has[1].T >= max(1, np.ceil(asked[3].shape[1] * 0.8))
        else:
            comparable = ~np.isnan(masked_distances(asked[3], block[3], metric))
        return pa.RecordBatch.from_arrays([asked[0], pa.array(allowed.sum(axis=1)), pa.array((allowed & comparable).sum(axis=1))], names=["query_id", "eligible", "comparable"])

    counted = _by_blocks(queries, store, stride, scope, count, "query_id string, eligible long, comparable long", BLOCK, BATCH)
    sums = counted.groupBy("query_id").agg(F.sum("eligible").alias("eligible"), F.sum("comparable").alias("comparable"))
    ids = queries.select(F.col("ref_id").alias("query_id"))
    return ids.join(sums, "query_id", "left").fillna(0, ["eligible", "comparable"])


def require_neighbours(found: DataFrame, queries: DataFrame, k: int) -> None:
    short = queries.select(F.col("ref_id").alias("query_id")).join(found.groupBy("query_id").count(), "query_id", "left").where(F.coalesce("count", F.lit(0)) < k)
    if short.limit(1).count():
        raise ValueError(f"some query has fewer than {k} neighbours")


def flat_search(queries: DataFrame, store: DataFrame, k: int) -> DataFrame:
    """The k nearest of a query's own series by squared distance, out of k + 1, the last left out; series of fewer candidates have none."""
    pairs = queries.alias("q").join(store.alias("d"), (F.col("q.item") == F.col("d.item")) & (F.col("q.channel") == F.col("d.channel")))
    square = F.aggregate(F.zip_with("q.rep", "d.rep", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select(F.col("q.ref_id").alias("query_id"), F.col("d.ref_id").alias("ref_id"), square.alias("distance"))
    w = W.partitionBy("query_id")
    ranked = scored.withColumn("rank", F.row_number().over(w.orderBy("distance", "ref_id"))).withColumn("_n", F.count("*").over(w))
    return ranked.where((F.col("_n") > k) & (F.col("rank") <= k)).drop("_n")


def gather(found: DataFrame, values: DataFrame, value: str, most: int) -> DataFrame:
    """query_id and neighbours, the looked-up values in order of rank (at most `most` each); an id without a value is an error."""
    joined = found.join(values.select("ref_id", value), "ref_id", "left")
    given = F.when(F.col(value).isNull(), F.raise_error(F.lit("a neighbour has no value"))).otherwise(F.col(value))
    lists = joined.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", given.alias("v")))).alias("n"))
    return lists.select("query_id", F.transform("n", lambda x: x["v"]).alias("neighbours"))
