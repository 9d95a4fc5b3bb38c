"""An extension: daily bars from a stream of events, in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Bars of windows of event time by user; an event later than `late` behind the newest is dropped.

    events: user_id, ts, value. State is one row per user and open window.
    """
    rows = events.where(F.col("value").isNotNull()).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width).alias("w"), F.col("user_id").alias("symbol")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return out.select("symbol", F.to_date("w.start").alias("date"), "open", "high", "low", "close", "volume")
