"""Time buckets over streams: what ``date_bin`` is on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucketed(stream: DataFrame, time_col: str, stride: str, keys: list[str], lateness: str, **aggregates) -> DataFrame:
    """Aggregates (name=Column) of each bucket and key; rows later than ``lateness`` are dropped by
    the watermark, which also bounds the state."""
    own = stream.withWatermark(time_col, lateness)
    found = own.groupBy(F.window(time_col, stride).alias("w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return found.select(F.col("w.start").alias("bucket"), *keys, *aggregates)
