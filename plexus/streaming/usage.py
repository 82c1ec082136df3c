"""Extension, not part of the engine's parity: usage counters from an event stream, in windows, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, user_id long, event_type string, ts timestamp, value double"


def event_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """A stream of Parquet event files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def usage_windows(events: DataFrame, length: str = "1 day", late: str = "2 days", time: str = "ts") -> DataFrame:
    """(id, since, reads, writes) per user and window, of a stream or a table. Purchases are writes, other events reads."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    bought = F.col("event_type") == "purchase"
    marked = events.withWatermark(time, late) if events.isStreaming else events
    grouped = marked.groupBy(F.window(time, length).alias("w"), F.concat(F.lit("u."), F.col("user_id").cast("string")).alias("id"))
    return grouped.agg(n(~bought).alias("reads"), n(bought).alias("writes")).select("id", F.col("w.start").cast("string").alias("since"), "reads", "writes")


def usage_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days", time: str = "ts") -> DataFrame:
    """(id, since, events) per user and session: events less than ``gap`` apart."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    grouped = marked.groupBy(F.session_window(time, gap).alias("w"), F.concat(F.lit("u."), F.col("user_id").cast("string")).alias("id"))
    return grouped.agg(F.count(F.lit(1)).alias("events")).select("id", F.col("w.start").cast("string").alias("since"), "events")
