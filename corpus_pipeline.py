"""The corpus pipeline over documents; part of subpackage llm.

Quality classifier, near-duplicates, mixing of sources, BPE encoding and decoding: each stage takes
what the one before kept, whole.  All but the last return the columns they are given, whatever else these
are called; the order in which mixing writes its rows is its decision.  Readers of its files do not keep that order, so the last
stage reads each row's place from the files (their numbers and the rows' numbers within) and gives it as
position, from 0 without gaps: the result ordered by position is the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.llm import bpe, mixing, quality
from chronoloom.llm.common import Tables, shared_path
from chronoloom.llm.near_dedup import near_duplicates
from chronoloom.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes; it learns from the labels outside the held-out fold."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=quality.held_out())
    held = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text"))
    return quality.with_quality(held, model).where("predicted = 1").select("doc.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest doc_id (of several with that id, one by the hash of its text); documents without an id stay."""
    firsts = near_duplicates(docs).where("first and doc_id is not null").groupBy("doc_id", "digest").count()
    firsts = Tables(spark).keep(firsts, "firsts")
    held = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", F.xxhash64(F.col("text").cast("string")).alias("digest"))
    kept = held.join(firsts.select("doc_id", "digest").hint("shuffle_hash"), ["doc_id", "digest"], "left_semi")
    if firsts.where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "digest"])
    return kept.select("doc.*").unionByName(docs.where(F.col("doc_id").isNull()))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    mixed = mixing.mix(docs.select("doc_id", "source", F.struct(*docs.columns).alias("doc")))
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select("doc.*")


def with_position(docs: DataFrame) -> DataFrame:
    """doc_id, text and position, the order in which the rows of docs were written to the Parquet files that it reads."""
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    placed = docs.select("doc_id", "text", F.struct(part.alias("part"), F.col("_metadata.file_name").alias("name")).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1))
    files = files.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each file
    return placed.join(F.broadcast(files), "_file").select("doc_id", "text", (F.col("_before") + F.col("_row")).alias("position"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in the order written, token ids (four bytes each, little-endian) and the digest of what they decode to."""
    keyed = with_position(docs).select(F.struct("doc_id", "position").alias("key"), "text")
    both = bpe.encode(keyed, tokenizer_path(), id_col="key", decoded=True)
    return both.select("key.doc_id", "key.position", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]
#: Compression, HyperMinHash and BPE are beyond SQL; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = shared_path(spark, "stage")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
