"""Windows over event time, for streams and for tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_time(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Event time as a timestamp, with a watermark where the frame is a stream."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", delay) if df.isStreaming else df


def windowed(events: DataFrame, length: str, slide: str | None = None, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(window_start, keys, n, total) of tumbling or sliding windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return with_time(events).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id") -> DataFrame:
    """(key, session_start, n): runs of events with less than a gap between them."""
    return with_time(events).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("session_start"), "n")


def once_per_id(events: DataFrame, key: str) -> DataFrame:
    df = with_time(events)
    return df.dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def drained(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what there is into an in-memory table of that name, for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
