"""Streams of events (ts, event_type, value): an addition to the batch operators, not a counterpart of any.

Each function is declarative and runs on batches and streams alike; run_once drives one to its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stages import exists


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tumbling_audit(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """start, event_type, events, missing, largest by tumbling windows; what is later than lateness is left out."""
    late = events.withWatermark("ts", lateness)
    agg = late.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.count_if(F.col("value").isNull()).alias("missing"), F.max("value").alias("largest"))
    return agg.select(F.col("w.start").alias("start"), "event_type", "events", "missing", "largest")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """user_id, start, stop, events by gaps."""
    agg = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("events"))
    return agg.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "events")


def run_once(frame: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is there to a table and ends."""
    frame.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_cache(frame: DataFrame, path: str, keys: list[str], checkpoint: str) -> None:
    """Adds rows whose keys the cache at path lacks, batch by batch."""

    def add(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(keys)
        if exists(batch.sparkSession, path):
            new = new.join(batch.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
        new.write.mode("append").parquet(path)

    frame.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
