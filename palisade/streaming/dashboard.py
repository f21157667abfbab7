"""Live-view figures kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.config import DEFAULTS, Settings


def events_per_second_stream(
    log: DataFrame, ts: str = "ts", lateness: str = "1 minute"
) -> DataFrame:
    """Events per one-second tick; a tick is emitted once, when no more events can fall in it."""
    zoned = log.select(F.col(ts).cast("timestamp").alias("_time"))
    return (
        zoned.withWatermark("_time", lateness)
        .groupBy(F.window("_time", "1 second").alias("_tick"))
        .agg(F.count("*").alias("events"))
        .select(F.col("_tick.start").cast("timestamp_ntz").alias("tick"), "events")
    )


def running_totals_stream(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Events and alerts so far, for a sink in ``complete`` mode."""
    alert = F.coalesce(F.col("anomaly_score") >= settings.anomaly_threshold, F.lit(False))
    return scored.agg(
        F.count("*").alias("total_events"), F.count_if(alert).alias("total_alerts")
    )
