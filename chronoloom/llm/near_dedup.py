"""Near-duplicate documents by HyperMinHash signatures.

A document's set holds the hashes of its distinct word shingles.  Its signature has ``rows * bands``
buckets.  A shingle falls into one bucket, which keeps the smallest value seen, compressed to a
leading-zero count and MANTISSA further bits; a bucket no shingle fell into takes the smallest of
all shingles under an odd multiplier of its own, so that short texts are not held alike for sharing
one shingle.  Bands of compressed registers propose candidates; the estimate of the Jaccard
similarity, corrected for registers that agree by chance, screens them; the full sets decide.

Steps: (1) signatures, one pass without a shuffle; (2) equal sets become one class, the node of all that
follows; (3) in each band bucket every class is linked to the smallest one; (4) connected components of
these links are clusters, outside of which no link is expected; (5) a cluster's classes are dealt into blocks
of about BLOCK, and each block, with the cluster's first class added to it, checks all its pairs: near copies of one text
come together here, however many; (6) only where a cluster of several blocks is still in several components
do pairs of blocks meet, with registers alone; those whose estimate reaches the threshold less the slack, and lie in different
components, are fetched and decided by their full sets, blocks of those outside the largest component against all; (7) components of the confirmed links.  No list
of pairs in a group is ever made, a group of any size is spread over many tasks, and a text goes to one
task unless a block of another component may hold a neighbour.

A link of similarity s is missed if no band agrees: with 5 rows and 40 bands 7e-11 at 0.85 and
1.3e-7 at 0.8; the screen leaves eight standard deviations.

Defined results: texts that are null or have no words have an empty set and are linked with nothing;
texts shorter than a shingle are one shingle; rows that share a doc_id are documents each, linked by
similarity alone; a null doc_id is linked with nothing and is kept; other columns are ignored; no rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, connected_components, rows_by_key, salted_join
from .shingles import U, mix, shingle_pieces, shingle_sets

ROWS, BANDS, MANTISSA = 5, 40, 10
#: Members of a block; a task holds two blocks.
BLOCK = 128
#: Standard deviations of the estimate that the screen allows.
SLACK = 8.0
#: Columns of the incidence matrix held at once.
COLUMNS = 4096
_NONE = U(2**64 - 1)


def _multipliers(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(977)).integers(1, 2**63, n, dtype=np.uint64) * U(2) + U(1)


def compress(values: np.ndarray) -> np.ndarray:
    """64-bit values as 16-bit registers: leading zeros in 6 bits, then the MANTISSA bits after the first one."""
    high = np.maximum(values >> U(11), U(1)).astype(np.float64)
    zeros = 53 - np.frexp(high)[1]
    mantissa = (values << (zeros + 1).astype(U)) >> U(64 - MANTISSA)
    return ((zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)).astype(np.uint16)


def signature(hashes: np.ndarray, size: int, multipliers: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set."""
    bucket = (((hashes >> U(32)) * U(size)) >> U(32)).astype(np.int64)
    values = mix(hashes ^ U(0x5851F42D4C957F2D))
    low = np.full(size, _NONE, dtype=U)
    np.minimum.at(low, bucket, values)
    if len(empty := np.flatnonzero(low == _NONE)):
        step = max(1, (1 << 18) // len(hashes))
        for at in range(0, len(empty), step):
            some = empty[at : at + step]
            low[some] = (values[:, None] * multipliers[None, some]).min(axis=0)
    return compress(low)


def band_keys(registers: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = registers.reshape(len(registers), bands, rows).astype(U)
    key = np.arange(1, bands + 1, dtype=U)[None, :] * U(0x9E3779B97F4A7C15)
    for r in range(rows):
        key = mix(key ^ (parts[:, :, r] + U(r + 1)) * U(0xC2B2AE3D27D4EB4F))
    return key


def chance(n_a: np.ndarray, n_b: np.ndarray, size: int) -> np.ndarray:
    """The share of registers of disjoint sets that agree by chance: the minima are nearly exponential, and a register is as wide as its value times about 0.7 / 2^MANTISSA."""
    a, b = np.maximum(n_a / size, 1.0), np.maximum(n_b / size, 1.0)
    return 0.7 / 2**MANTISSA * a * b / (a + b) ** 2


def estimate(a: np.ndarray, n_a: np.ndarray, b: np.ndarray | None = None, n_b: np.ndarray | None = None) -> np.ndarray:
    """Collision-corrected Jaccard estimates of all pairs of two blocks' signatures, or of one's."""
    size = a.shape[1]
    if b is None:
        b, n_b = a, n_a
    same = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        same[i] = (b == row).mean(axis=1)
    by_chance = chance(n_a[:, None], n_b[None, :], size)
    return (same - by_chance) / (1 - by_chance)


def screened(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, at: float) -> np.ndarray:
    """Which pairs' similarity may reach at."""
    return estimate(a, n_a, b, n_b) >= at - SLACK * np.sqrt(at * (1 - at) / a.shape[1]) - 1e-9


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of slices of the incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1
    place = np.cumsum(shared) - 1
    owner, column = owner[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for low in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        total += (part @ part.T).astype(np.int64)
    return total


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """(member, smallest member reachable) for the members that a link matrix joins to a smaller one."""
    label = np.arange(len(links))
    while True:
        low = np.where(links, label[None, :], len(links)).min(axis=1)
        after = np.minimum(label, low)
        after = after[after]
        if (after == label).all():
            return [(i, int(x)) for i, x in enumerate(label) if x != i]
        label = after


def linked(sets: list[np.ndarray], registers: np.ndarray, num: int, den: int, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links den * |a & b| >= num * |a | b| among non-empty sets (and pairs apart, if given)."""
    counts = np.array([len(s) for s in sets], dtype=np.int64)
    likely = screened(registers, counts, registers, counts, num / den)
    np.fill_diagonal(likely, False)
    if apart is not None:
        likely &= apart
    if not likely.any():
        return []
    both = intersections(sets)
    links = likely & (den * both >= num * (counts[:, None] + counts[None, :] - both))
    return forest(links)


def signatures(docs: DataFrame, n: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a digest of the set) and the band keys of (doc_id, text, digest), with digest."""
    size = rows * bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(size)
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            digest = np.zeros((batch.num_rows, 2), U)
            registers = np.zeros((batch.num_rows, size), np.uint16)
            for first, hashes, offsets in shingle_pieces(batch.column(1), n):
                for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True), first):
                    if a == b:
                        continue
                    own = np.unique(hashes[a:b])
                    counts[k] = len(own)
                    digest[k, 0] = np.bitwise_xor.reduce(mix(own))
                    digest[k, 1] = mix(own + U(0x165667B19E3779F9)).sum(dtype=U)
                    registers[k] = signature(own, size, multipliers)
            keys = band_keys(registers, rows, bands).view(np.int64)
            has = counts > 0
            offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].ravel())), batch.column(2)],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "digest"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, digest long")


def _distinct(nodes: np.ndarray) -> np.ndarray:
    """Places of the first row of each node, by ascending node."""
    return np.unique(nodes, return_index=True)[1]


def within_blocks(members: DataFrame, n: int, num: int, den: int, size: int) -> DataFrame:
    """Links (a, b) of each block's own pairs, and (cluster, own, node, shingles, registers) of its members; members has cluster, block, own, node, text, dealt by the first two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(size)
        names, kinds = ["a", "b", "cluster", "own", "node", "shingles", "registers"], [*[pa.int64()] * 3, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for (cluster, block), rows in rows_by_key(batches, 2):
            nodes = rows.column(3).to_numpy()
            first = _distinct(nodes)
            nodes, own = nodes[first], rows.column(2).to_numpy()[first]
            sets = list(shingle_sets(rows.column(4).take(pa.array(first)), n))
            registers = np.stack([signature(s, size, multipliers) for s in sets])
            out = [(int(nodes[i]), int(nodes[j]), None, None, None, None, None) for i, j in linked(sets, registers, num, den)]
            out += [(None, None, cluster, block, int(nodes[i]), len(sets[i]), registers[i].tobytes()) for i in np.flatnonzero(own == block)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return members.mapInArrow(run, "a long, b long, cluster long, own int, node long, shingles long, registers binary")


def across_blocks(members: DataFrame, num: int, den: int) -> DataFrame:
    """(cluster, i, j, node, part) of the members of a pair of blocks that may be linked to one of another component on the other side; members has cluster, i, j, side, node, part, shingles, registers, dealt by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cluster, i, j), rows in rows_by_key(batches, 3):
            side, node, part, count = (rows.column(k).to_numpy() for k in (3, 4, 5, 6))
            registers = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint16).reshape(len(side), -1)
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(a) or not len(b):
                continue
            likely = screened(registers[a], count[a], registers[b], count[b], num / den) & (part[a][:, None] != part[b][None, :])
            found = np.concatenate([a[likely.any(axis=1)], b[likely.any(axis=0)]])
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array([cluster] * len(found), pa.int64()), pa.array([i] * len(found), pa.int32()), pa.array([j] * len(found), pa.int32()), pa.array(node[found]), pa.array(part[found])], names=["cluster", "i", "j", "node", "part"])

    return members.mapInArrow(run, "cluster long, i int, j int, node long, part long")


def confirmed(members: DataFrame, n: int, num: int, den: int, size: int) -> DataFrame:
    """Links (a, b) of components, confirmed on full sets; members has cluster, i, j, node, part, text, dealt by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(size)
        for _, rows in rows_by_key(batches, 3):
            first = _distinct(rows.column(3).to_numpy())
            part = rows.column(4).to_numpy()[first]
            sets = list(shingle_sets(rows.column(5).take(pa.array(first)), n))
            registers = np.stack([signature(s, size, multipliers) for s in sets])
            pairs = linked(sets, registers, num, den, part[:, None] != part[None, :])
            if pairs:
                found = part[np.array(pairs)]
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, rows: int = ROWS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept, digest (xxhash64 of the text) and first, a row for each row of docs.

    kept: the doc_id is the component's; first: doc_id and digest are those of the component's one document to keep,
    also where rows share a doc_id.  Documents are linked where ``den * |a & b| >= num * |a | b|`` for their sets of n-word shingles.
    """
    tables = Tables(docs.sparkSession)
    size = rows * bands
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("digest", F.xxhash64("text"))
    signed = tables.keep(signatures(docs, n, rows, bands), "signatures")
    owned = signed.where("n_shingles > 0 and doc_id is not null")
    grouped = owned.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "digest")).alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    # Nodes are numbered as they are written; every later step reads the numbers.
    classes = tables.keep(grouped.select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", "rep", "copies", "bands"), "classes")

    keys = classes.select("node", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").drop("last")
    proposed = keys.join(heads.hint("shuffle_hash"), "key").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    clusters = connected_components(tables, proposed, "proposed")

    # Blocks of each cluster; its first class is in all of them.
    blocks = clusters.groupBy(F.col("component").alias("cluster")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = salted_join(clusters.withColumnRenamed("component", "cluster"), blocks, ["cluster"], "node")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.join(classes.select("node", "rep.doc_id", "rep.digest").hint("shuffle_hash"), "node")
    members = tables.keep(docs.where("doc_id is not null").join(dealt.hint("shuffle_hash"), ["doc_id", "digest"]).select("cluster", "blocks", "own", "node", "text"), "members")
    to = F.when(F.col("node") == F.col("cluster"), F.expr("sequence(0, blocks - 1)")).otherwise(F.array("own"))
    placed = members.withColumn("block", F.explode(to)).select("cluster", "block", "own", "node", "text")
    first = tables.keep(within_blocks(placed.repartition("cluster", "block").sortWithinPartitions("cluster", "block"), n, num, den, size), "within")
    links = connected_components(tables, first.where("a is not null").select("a", "b"), "confirmed")
    part = links.select("node", F.col("component").alias("part"))

    # Clusters of several blocks that are still in several components.
    known = first.where("node is not null").select("cluster", "own", "node", "shingles", "registers")
    known = known.join(part.hint("shuffle_hash"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = known.groupBy("cluster", "part").agg(F.count("*").alias("n"), F.max("own").alias("last"))
    split = sizes.groupBy("cluster").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), (F.max("last") + 1).alias("blocks"))
    split = split.where("n > main.n and blocks > 1").select("cluster", F.col("main.part").alias("main"), "blocks", F.ceil((F.col("n") - F.col("main.n")) / block).cast("int").alias("outer"))
    split = tables.keep(split, "split")
    further = None
    if split.limit(1).count():
        open_ = salted_join(known, split, ["cluster"], "node", "inner")
        every = open_.select("cluster", F.explode(F.expr("sequence(0, outer - 1)")).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "node", "part", "shingles", "registers")
        outside = open_.where("part <> main").withColumn("i", F.pmod(F.xxhash64("node", F.lit(9)), F.col("outer")).cast("int"))
        outside = outside.select("cluster", "i", F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"), F.lit(0).alias("side"), "node", "part", "shingles", "registers")
        open_ = every.unionByName(outside)
        likely = tables.keep(across_blocks(open_.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j"), num, den), "likely")
        texts = likely.join(members.select("node", "text").dropDuplicates(["node"]).hint("shuffle_hash"), "node").select("cluster", "i", "j", "node", "part", "text")
        further = connected_components(tables, confirmed(texts.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j"), n, num, den, size), "further")

    # The smallest (doc_id, digest) of each component, for the classes that have copies or links.
    joined = classes.select("node", "set_a", "set_b", "rep", "copies").join(part.hint("shuffle_hash"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    if further is not None:
        joined = salted_join(joined, further.select(F.col("node").alias("part"), "component"), ["part"], "node").withColumn("part", F.coalesce("component", "part")).drop("component")
    joined = tables.keep(joined, "joined")
    least = joined.groupBy("part").agg(F.min("rep").alias("least"), F.sum("copies").alias("_n")).where("_n > 1").drop("_n")
    named = salted_join(joined.select("part", "node", "set_a", "set_b"), least, ["part"], "node", "inner").select("set_a", "set_b", "least")
    out = salted_join(signed.drop("bands"), named, ["set_a", "set_b"], "digest")
    linked_ = F.col("least").isNotNull() & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = out.withColumn("component_id", F.when(linked_, F.col("least.doc_id")).otherwise(F.col("doc_id")))
    first = ~linked_ | (F.col("least") == F.struct("doc_id", "digest"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "digest", first.alias("first"))
