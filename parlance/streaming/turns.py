"""The same measures over streams of events and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, length: str = "6 hours", slide: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """Events and value by sliding event-time window and type; on a stream, windows close `late` after their end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("ts", length, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events less than `gap` apart."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")


def deduplicated(turns: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """First copy of each turn; state is dropped after the watermark."""
    return turns.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if turns.isStreaming else turns.dropDuplicates(keys)
