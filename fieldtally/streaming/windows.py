"""Streaming extensions: event-time windows with watermarks, and replay-safe appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events and mean value by event-time window and type; rows later than ``late`` are dropped. Works on batches too."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        ts = ts.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return ts.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: runs of events with smaller gaps."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        ts = ts.withWatermark("ts", late)
    return ts.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch to a folder named by its id, so that a batch that runs again replaces itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
