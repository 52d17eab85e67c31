"""Streams (an extension): windowed aggregates with watermarks, on streams and batches alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, keys: list[str], width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """(start, keys, n, total): counts and sums in windows of event time; ``late`` bounds how long a stream waits."""
    rows = events.withWatermark(at, late) if late and events.isStreaming else events
    out = rows.groupBy(F.window(at, width, slide), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(at, late) if late and events.isStreaming else events
    out = rows.groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), *keys, "n")


def once(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each key's first arrival; a stream forgets keys behind its watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
