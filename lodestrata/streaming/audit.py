"""Audit events and sessions as streams: an addition to the batch operators, with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream of events."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """event_type, started, n, total by the hour; events later than the watermark are left out, and an hour is final once it passes."""
    x = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("started"), "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """user_id, started, ended, n of each run of events without a longer gap."""
    x = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return x.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def first_seen(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without repeats of an id that come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def append(stream: DataFrame, path: str, checkpoint: str):
    """Starts appending the stream's final rows to a Parquet table; it ends when what is there has been read."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
