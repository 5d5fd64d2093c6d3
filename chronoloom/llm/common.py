"""Shared folders, written tables and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that the rows of one side of a join on a possibly hot key are dealt into.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset, as in tests."""
    conf = spark.sparkContext.getConf()
    if not (root := conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)):
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="chronoloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/chronoloom-{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this package wrote, whatever file system holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Tables:
    """Tables written to the shared folder to cut lineage; drop() deletes those no longer read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def keep(self, frame: DataFrame, label: str) -> DataFrame:
        path = shared_path(self.spark, label)
        frame.write.parquet(path)
        self.paths[label] = path
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        for label in labels:
            delete_path(self.spark, self.paths.pop(label))


def salted_join(many: DataFrame, few: DataFrame, on: list[str], spread: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Joins on a key that may hold a third of many's rows: these are dealt into salts parts by the column spread; few is repeated for each.  Never by broadcast, since few may grow."""
    salt = F.explode(F.array(*map(F.lit, range(salts))))
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return left.join(few.withColumn("_salt", salt).hint("shuffle_hash"), [*on, "_salt"], how).drop("_salt")


def connected_components(tables: Tables, edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds: each node's neighbours are linked to the smallest
    of them.  A node's smallest neighbour comes from a partial aggregation and is joined back with salt,
    so a node with very many neighbours is never gathered in one task.  Every round is written to the
    shared folder.  No edges: no rows.
    """

    def least(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        return salted_join(pairs, low, ["u"], "v", "inner", 8)

    def sums(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.when(F.col("b").isNull(), 1))).first())

    def ordered(frame: DataFrame, a: str, b: str) -> DataFrame:
        return frame.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()

    now = tables.keep(ordered(edges, "a", "b"), f"{label}0")
    seen, turn = sums(now), 0
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = ordered(least(both).where("v > u"), "v", "low")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = least(down)
        small = ordered(low.select("v", "low").unionByName(low.select(F.col("u").alias("v"), "low")), "v", "low")
        turn += 1
        after = tables.keep(small, f"{label}{turn}")
        tables.drop(f"{label}{turn - 1}")
        now, last, seen = after, seen, sums(after)
        if seen == last:
            break
    member = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return member.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def rows_by_key(batches: Iterable, keys: int):
    """Runs of rows equal in the first columns, out of Arrow batches sorted by them: lists of column lists.

    A run may span batches; only one run is held at a time.
    """
    import pyarrow as pa

    held: list = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key_rows = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        start = 0
        for i in range(1, len(key_rows) + 1):
            if i == len(key_rows) or key_rows[i] != key_rows[start]:
                part = batch.slice(start, i - start)
                if held and held_key == key_rows[start]:
                    held.append(part)
                else:
                    if held:
                        yield held_key, pa.Table.from_batches(held)
                    held, held_key = [part], key_rows[start]
                start = i
    if held:
        yield held_key, pa.Table.from_batches(held)
