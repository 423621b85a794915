"""Documents and events as streams: the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_documents(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unique(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Documents whose text has not come within the delay: the state is bounded by the watermark."""
    return stream.withWatermark(time, delay).withColumn("text_hash", F.sha2("text", 256)).dropDuplicatesWithinWatermark(["text_hash"])


def windows(events: DataFrame, size: str = "1 day", slide: str | None = None, delay: str | None = None) -> DataFrame:
    """(start, event_type, n, value) in windows of time; with a delay, late events within it still count."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", delay) if delay else timed
    return timed.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n): sessions that end after a gap."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
