"""Streaming forms of the weekly buckets, beyond the batch engine: event-time weeks with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_totals(events: DataFrame, late: str = "14 days") -> DataFrame:
    """Sum and count of value by event type and Monday week of a stream of (ts, event_type, value); rows later than ``late``
    behind the newest are dropped."""
    week = F.window("ts", "7 days", startTime="4 days")
    a = events.withWatermark("ts", late).groupBy(week.alias("w"), "event_type").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return a.select(F.col("w.start").cast("date").alias("week"), "event_type", "total", "n")


def run_once(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """What is there now, run to the end into a memory table; the checkpoint lets a later run go on."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
