"""Structured Streaming jobs over the clickstream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import is_positive


def event_time(events: DataFrame, ts: str = "event_ts") -> DataFrame:
    """Watermarks need TIMESTAMP, so naive times are cast (the session time zone is UTC)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_trending(events: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and positives per item over sliding windows.

    Late events beyond the watermark are dropped; a repeated ``event_id`` counts once. State is
    bounded by the watermark: ids of one day and the open windows.
    """
    unique = event_time(events).withWatermark("event_ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return unique.groupBy(F.window("event_ts", window, slide), "item_id").agg(
        F.count("*").alias("events"), F.count_if(is_positive()).alias("positives")
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "item_id", "events", "positives")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Gap sessions per user with counts; a session is emitted once the watermark has passed it."""
    marked = event_time(events).withWatermark("event_ts", late)
    return marked.groupBy(F.session_window("event_ts", gap), "user_id").agg(
        F.count("*").alias("events"), F.count_if(is_positive()).alias("positives")
    ).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events", "positives")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything that is there now into parquet, then stop; restarts go on from the checkpoint."""
    job = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
    job.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
