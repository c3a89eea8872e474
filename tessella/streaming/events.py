"""Windowed aggregates with watermarks; the same functions run on batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of windows of ``width``; with ``late``, older rows are dropped."""
    e = events.withWatermark("ts", late) if late else events
    d = e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return d.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    d = e.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))
    return d.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): a user's events with no pause of ``gap`` or more."""
    e = events.withWatermark("ts", late) if late else events
    d = e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return d.select("user_id", F.col("session_window.start").alias("start"), "last", "n")


def distinct_events(events: DataFrame, late: str) -> DataFrame:
    """Each event once, repeats recognised within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
