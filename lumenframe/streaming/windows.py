"""Streaming aggregates: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, keys: list[str], window: str = "1 day", late: str = "1 hour", value: str | None = None) -> DataFrame:
    """(window start, keys, n, total): rows later than ``late`` behind the newest are left out."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    base = stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(*aggs)
    return base.select(F.col("window.start").alias("start"), *keys, *[c for c in ("n", "total") if c in base.columns])
