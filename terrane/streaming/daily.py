"""Daily tumbling means, for tables and for streams (an extension: observations that arrive over time)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_means(events: DataFrame, late: str = "1 day") -> DataFrame:
    """window, event_type, n, mean. On a stream, days close once the watermark has passed them."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
