"""Event streams: windows with watermarks, sessions, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums of ``value`` in windows of ``ts``, by keys; events later than ``late`` are dropped."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = own.groupBy(F.window("ts", width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, slide: str, *keys: str, late: str = "1 hour") -> DataFrame:
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = own.groupBy(F.window("ts", width, slide), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a key: events less than ``gap`` apart belong together."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = own.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def answer_times(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """(message_id, first_token_s, total_s) from tokens (message_id, ts) and questions (message_id, asked_at)."""
    own = tokens.groupBy("message_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    seconds = lambda c: F.col(c).cast("timestamp").cast("double") - F.col("asked_at").cast("timestamp").cast("double")
    return asked.join(own, "message_id").select("message_id", seconds("a").alias("first_token_s"), seconds("b").alias("total_s"))
