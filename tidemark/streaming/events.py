"""Event-time windows as one plan for batch and stream: tumbling, sliding and session counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type. On a stream, rows later than ``late`` are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a user that end after ``gap`` without an event."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is available now to a Parquet table, exactly once a checkpoint."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()
