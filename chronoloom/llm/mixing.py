"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are dealt into blocks.  With weight w (of all weights' sum), its j-th block
(from 1) is released at slot floor((j-1)/w) and due by slot ceil(j/w); in every slot the released block
of earliest deadline goes.  Releases and deadlines are whole-number arithmetic on the weights as given
(a float is the rational number it stands for), over all blocks there are, so every deadline is met and
in each prefix a source, while it lasts, is less than one block from its weight times the slots, however
long the input.  Slots of a source that has run out stay empty; positions count the documents, so nothing
is dropped.

The schedule is worked out on the driver, a step for each block that exists (a heap; empty slots cost
nothing), and goes to the documents as 16 bytes a block, a byte a document: by broadcast up to
BROADCAST_BLOCKS, beyond that by a join on runs of RUN blocks.  So that the driver's work is bounded at
any size, a block has as many documents more than asked for as it takes for BLOCKS blocks to hold all; the deviation
is then below one such block, a part in BLOCKS of the input.  All else is DataFrame functions.
Documents of a source are numbered in three levels (about CHUNK rows, CHUNK chunks, chunks of chunks), so
that no task holds a whole source, however large, nor all rows of a key that repeats unless they are the same throughout.

Only if a period is asked for are weights rounded, to whole parts of it that sum to it (parts_of), and
the bound holds for those.

Defined results: a null source is a source of its own; documents that repeat each have a position; a
source without a given weight, or weights that do not name all sources, is an error, as is a weight so
small that a slot passes 2^63; the order within a source is by hashes of the row and the key; other columns are
passed on; no rows give no rows.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK, CHUNK = 16, 1024
#: Blocks in a row of the schedule's table, and blocks (or sources) that are broadcast at most.
RUN, BROADCAST_BLOCKS = 4096, 2_000_000
#: Blocks of a schedule, about, and sources at most.
BLOCKS = 4_000_000
#: Where no weights are given, they are in proportion to the sources' sizes to this power.
TEMPERATURE = 0.5


def parts_of(weights: list[float], period: int) -> list[int]:
    """Whole parts of period in proportion to weights, each at least one, by largest remainder."""
    if any(w <= 0 for w in weights) or len(weights) > period:
        raise ValueError("weights must be positive, and no more of them than slots of a period")
    spare, total = period - len(weights), sum(weights)
    exact = [w / total * spare for w in weights]
    parts = [int(x) for x in exact]
    for i in sorted(range(len(weights)), key=lambda i: (parts[i] - exact[i], i))[: spare - sum(parts)]:
        parts[i] += 1
    return [p + 1 for p in parts]


def schedule(parts: Column, period: int) -> Column:
    """The source (index into parts) of every slot of a period, as a column: earliest deadline first among released blocks."""
    n = F.size(parts)
    start = F.struct(F.transform(parts, lambda a: F.lit(0)).alias("done"), F.expr("cast(array() as array<int>)").alias("slots"))

    def step(state: Column, t: Column) -> Column:
        rank = F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(
                F.when(
                    F.expr("true") & (F.floor(F.get(state["done"], i) * period / F.get(parts, i)) <= t),
                    F.ceil((F.get(state["done"], i) + 1) * period / F.get(parts, i)),
                )
                .otherwise(F.lit(2**40))
                .cast("long")
                .alias("due"),
                i.cast("int").alias("i"),
            ),
        )
        best = F.array_min(rank)["i"]
        done = F.transform(state["done"], lambda d, i: F.when(i == best, d + 1).otherwise(d))
        return F.struct(done.alias("done"), F.concat(state["slots"], F.array(best)).alias("slots"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), start, step, lambda s: s["slots"])


def exact_parts(weights: list) -> list[int]:
    """Whole numbers in the very proportion of weights (whole, rational or floating point numbers)."""
    if any(not 0 < w < math.inf for w in weights):
        raise ValueError("weights must be positive and finite")
    exact = [Fraction(w) for w in weights]
    common = math.lcm(*[w.denominator for w in exact])
    whole = [w.numerator * (common // w.denominator) for w in exact]
    divisor = math.gcd(*whole)
    return [w // divisor for w in whole]


def slots_of(parts: list[int], blocks: list[int]) -> list[tuple[int, int]]:
    """(slot, source) of every block in the order they go; source i has blocks[i] of them and weight parts[i] of the parts' sum."""
    total, out = sum(parts), []
    done = [0] * len(parts)
    ready = [(-(-total // a), i) for i, (a, n) in enumerate(zip(parts, blocks, strict=True)) if n]
    later: list[tuple[int, int]] = []
    heapq.heapify(ready)
    t = 0
    while ready or later:
        if not ready:
            t = max(t, later[0][0])
        while later and later[0][0] <= t:
            i = heapq.heappop(later)[1]
            heapq.heappush(ready, (-(-(done[i] + 1) * total // parts[i]), i))
        i = heapq.heappop(ready)[1]
        out.append((t, i))
        t += 1
        done[i] += 1
        if done[i] < blocks[i]:
            heapq.heappush(later, (done[i] * total // parts[i], i))
    return out


def _few(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= BROADCAST_BLOCKS else frame.hint("shuffle_hash")


def numbered(rows: DataFrame, group: str, key: str, sizes: DataFrame, groups: int) -> DataFrame:
    """rows with column ordinal, from 0 in each group, in three levels of prefix sums; sizes has (group, rows), a row for each of the groups."""
    width = F.greatest(F.ceil(F.col("_rows") / CHUNK), F.lit(1)).cast("long")
    plain = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    hashed = rows.join(_few(sizes.withColumnRenamed("rows", "_rows"), groups), group).withColumn("_hash", F.xxhash64(key)).withColumn("_whole", F.xxhash64(key, *plain))
    hashed = hashed.withColumn("_chunk", F.pmod(F.col("_whole"), width)).drop("_rows")
    chunks = hashed.groupBy(group, "_chunk").agg(F.count("*").alias("_n")).withColumn("_over", F.floor(F.col("_chunk") / CHUNK))
    over = chunks.groupBy(group, "_over").agg(F.sum("_n").alias("_m"))
    before = lambda what, w: F.coalesce(F.sum(what).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    over = over.select(group, "_over", before("_m", W.partitionBy(group).orderBy("_over")).alias("_far"))
    chunks = chunks.withColumn("_near", before("_n", W.partitionBy(group, "_over").orderBy("_chunk"))).join(over, [group, "_over"])
    chunks = chunks.select(group, "_chunk", (F.col("_near") + F.col("_far")).alias("_base"))
    own = W.partitionBy(group, "_chunk").orderBy("_hash", key, "_whole")
    placed = hashed.withColumn("_own", F.row_number().over(own) - 1).join(chunks, [group, "_chunk"])
    return placed.withColumn("ordinal", F.col("_own") + F.col("_base")).drop("_hash", "_whole", "_chunk", "_own", "_base")


def mix(docs: DataFrame, weights: dict | None = None, source_col: str = "source", key_col: str = "doc_id", block: int = BLOCK, period: int | None = None) -> DataFrame:
    """docs with columns source_block (from 0 in its source), slot and position (from 0, without gaps); documents of a slot follow by their order in the source."""
    added = ["source_block", "slot", "position"]
    columns = [c for c in docs.columns if c not in added]
    label = F.struct(F.col(source_col).isNull(), F.col(source_col)).cast("struct<a: boolean, b: string>").cast("string").alias("_source")
    keyed = docs.select(F.struct(*columns).alias("_doc"), F.col(key_col).alias("_key"), label)  # whatever the given columns are called
    counted = docs.groupBy(source_col).agg(F.count("*").alias("rows")).select(source_col, "rows", label).orderBy(source_col).limit(BLOCKS + 1).collect()  # a row for each source of the mixture
    if not counted:
        return docs.select(*columns, *[F.lit(None).cast("long").alias(c) for c in added])
    names = [r[0] for r in counted]
    if len(names) > BLOCKS:
        raise ValueError(f"more than {BLOCKS} sources")
    block = max(block, -(-sum(r.rows for r in counted) // BLOCKS))
    if weights is not None and set(weights) != set(names):
        raise ValueError(f"weights must name the sources {names}")
    target = [weights[s] if weights is not None else r.rows**TEMPERATURE for s, r in zip(names, counted, strict=True)]
    parts = parts_of(target, period) if period else exact_parts(target)

    # The slot of every block, and the documents that go before it.
    slots, before, last = [[] for _ in names], [[] for _ in names], 0
    for t, i in slots_of(parts, [-(-r.rows // block) for r in counted]):
        slots[i].append(t)
        before[i].append(last)
        last += min(block, counted[i].rows - block * (len(slots[i]) - 1))
    if max(s[-1] for s in slots) >= 2**63:
        raise ValueError("a weight is too small: its slots pass 2^63")
    spark = docs.sparkSession
    runs = [(r["_source"], k // RUN, slots[i][k : k + RUN], before[i][k : k + RUN]) for i, r in enumerate(counted) for k in range(0, len(slots[i]), RUN)]
    table = spark.createDataFrame(runs, "_source string, _run long, _slots array<long>, _before array<long>")
    sizes = spark.createDataFrame([(r["_source"], r.rows) for r in counted], "_source string, rows long")

    rows = numbered(keyed, "_source", "_key", sizes, len(counted))
    rows = rows.withColumn("source_block", F.floor(F.col("ordinal") / block)).withColumn("_run", F.floor(F.col("source_block") / RUN))
    rows = rows.join(_few(table, sum(map(len, slots))), ["_source", "_run"])
    at = lambda c: F.get(c, F.pmod("source_block", F.lit(RUN)).cast("int"))
    return rows.select("_doc.*", "source_block", at("_slots").alias("slot"), (at("_before") + F.pmod("ordinal", F.lit(block))).alias("position"))
