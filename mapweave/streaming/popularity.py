"""Popularity as a stream: tumbling windows of event values with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_popularity(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(article_id, start, popularity) of a stream or table (ts, user_id, value); later events than `late` are dropped from a stream."""
    rows = events.filter("value is not null")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    sums = rows.groupBy(F.window("ts", window), F.col("user_id").alias("article_id")).agg(F.sum("value").alias("popularity"))
    return sums.select("article_id", F.col("window.start").alias("start"), "popularity")
