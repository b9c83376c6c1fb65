"""Event-time operators over a stream of events, and runs over what is there already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: How late an event may come and still count.
LATENESS = "7 days"


def events(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A stream over the files of a folder; times without a zone are UTC."""
    return spark.readStream.schema(EVENT.replace("ts timestamp", "ts timestamp_ntz")).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts and sums by window and type."""
    w = stream.withWatermark("ts", LATENESS).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, width: str = "7 days", slide: str = "1 day") -> DataFrame:
    w = stream.withWatermark("ts", LATENESS).groupBy(F.window("ts", width, slide))
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(stream: DataFrame, gap: str = "1 hour") -> DataFrame:
    w = stream.withWatermark("ts", LATENESS).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def first_seen(stream: DataFrame) -> DataFrame:
    """Each event once within the lateness; replays are dropped."""
    return stream.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["event_id"])


def run_available(result: DataFrame, table: str, checkpoint: str, mode: str = "complete") -> None:
    """Processes what is there now into a table in memory, then ends."""
    q = result.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
