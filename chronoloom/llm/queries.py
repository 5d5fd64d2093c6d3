"""The queries that apply the operators of this subpackage to whole tables: (spark, sf_dir) to a DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, html_extract, licenses, mixing, quality, sharding, topk, warc
from .common import Tables
from .near_dedup import near_duplicates

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_extract.extract(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents as files of a tree source/lang/<4096 ids>/<64 ids>.

    The table has no paths, so the first document of every directory of every level lies in that directory, not below
    it (in the highest, if it is the first of several), and stands for its licence file.
    """
    docs = _table(spark, sf_dir, "documents")
    parts = [F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 4096).cast("string"), F.floor(F.col("doc_id") / 64).cast("string")]
    names = [f"d{k}" for k in range(len(parts))]
    placed = docs.select("doc_id", "text", *[p.alias(n) for p, n in zip(parts, names, strict=True)])
    firsts = [placed.groupBy(*names[: k + 1]).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(k + 1).alias("level")) for k in range(len(parts))]
    level = functools.reduce(DataFrame.unionByName, firsts).groupBy("doc_id").agg(F.min("level").alias("level"))
    level = Tables(spark).keep(level, "levels")
    # Text is read once: the places are joined to what the scan of it leaves.
    whole = licenses.own_licenses(placed, named=level.select("doc_id")).join(level.hint("shuffle_hash"), "doc_id", "left")
    folder = F.concat_ws("/", F.slice(F.array(*names), F.lit(1), F.coalesce("level", F.lit(len(parts)))))
    files = whole.select("doc_id", F.concat_ws("/", folder, F.col("doc_id")).alias("path"), F.col("level").isNotNull().alias("is_license"), "license", "score")
    found = licenses.inherited(files)
    return found.select("doc_id", "path", "license", F.round("score", 6).alias("score"), "license_source", "inherited_from", "effective_license")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels outside the held-out fold."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, held_out=quality.held_out())
    return quality.with_quality(docs.select("doc_id", "text"), model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture."""
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as records of deduplicated archives, read back."""
    manifest, folder = warc.deduplicated(_table(spark, sf_dir, "pages"))
    files = manifest.repartitionByRange(max(1, manifest.count()), "file")  # about a file to a task
    return warc.read_archives(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    both = bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path(), decoded=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(_table(spark, sf_dir, "documents"), n=3, num=85, den=100).select("doc_id", "n_shingles", "component_id", "kept")


def op9_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 64."""
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fiftieth vector's five largest inner products."""
    vectors = topk.integers(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("id") % 50 == 0, k=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return oracle.SQL
