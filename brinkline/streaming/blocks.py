"""Tumbling and sliding block maxima over a stream with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_block_maxima(stream: DataFrame, late: str, size: str, keys: list[str], time: str = "ts", value: str = "value", slide: str | None = None) -> DataFrame:
    """Maximum and count per key and window; rows later than ``late`` are dropped by the watermark."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(*keys, window.alias("w")).agg(F.max(value).alias("maximum"), F.count(value).alias("n")).select(*keys, F.col("w.start").alias("block"), "maximum", "n")
