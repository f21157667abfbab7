"""Figures of the live view as queries over scored events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.config import DEFAULTS, Settings
from palisade.functions.scoring import alert_severity, table_band
from palisade.session import stored

# Sizes of the live view.
ROLLING_SCORES = 500
TIMELINE_TICKS = 60
TABLE_ROWS = 200
FEED_ROWS = 50

_RANKS_PER_TASK = 100_000


def in_ranges(scored: DataFrame, ts: str = "ts") -> DataFrame:
    """Id, time and score, stored, with the number ``_range`` of one of successive ranges of ``(ts, id)``.

    Ranges have nearly equal size, whatever the times. Their bounds come from a sample, so the rows
    are stored before; the number is stored, so later jobs can't see another division.
    """
    events = stored(scored.select("id", ts, "anomaly_score"), "live-scores")
    numbered = events.repartitionByRange(ts, "id").withColumn("_range", F.spark_partition_id())
    return stored(numbered, "live-ranges")


def ranked(scored: DataFrame, ts: str = "ts", settings: Settings = DEFAULTS) -> DataFrame:
    """Id, time and score with ``_rank`` (1 = oldest by ``(ts, id)``) and ``_alerts``, the running
    alert count.

    A global window would put the table into one task, and windows per second a hot second. Instead
    events are cut into ranges, each range is counted, and an event adds its place within its range to
    the ranges before.
    """
    ranges = in_ranges(scored, ts)
    is_alert = F.coalesce(F.col("anomaly_score") >= settings.anomaly_threshold, F.lit(False))
    all_before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: as many as the shuffle has partitions.
    before = (
        ranges.groupBy("_range").agg(F.count("*").alias("_n"), F.count_if(is_alert).alias("_a"))
        .select(
            "_range",
            F.coalesce(F.sum("_n").over(all_before), F.lit(0)).alias("_before_n"),
            F.coalesce(F.sum("_a").over(all_before), F.lit(0)).alias("_before_a"),
        )
    )
    in_range = Window.partitionBy("_range").orderBy(ts, "id")
    upto = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranges.withColumn("_place", F.row_number().over(in_range))
        .withColumn("_own", F.count_if(is_alert).over(upto))
        .join(F.broadcast(before), "_range")
        .select(
            "id",
            ts,
            "anomaly_score",
            (F.col("_before_n") + F.col("_place")).alias("_rank"),
            (F.col("_before_a") + F.col("_own")).alias("_alerts"),
        )
    )


def rolling_avg_score(
    scored: DataFrame, ts: str = "ts", rows: int = ROLLING_SCORES, settings: Settings = DEFAULTS
) -> DataFrame:
    """Mean of the latest ``rows`` scores after each event; a missing score counts as 0.

    Events are cut into runs of equal length by rank, each run starting with a copy of the
    ``rows`` events before it, so the work spreads evenly whatever the rate.
    """
    run = max(_RANKS_PER_TASK, rows)
    base = ranked(scored, ts, settings).select(
        "id", ts, "_rank", F.coalesce("anomaly_score", F.lit(0.0)).alias("_score")
    )
    first = F.floor((F.col("_rank") - 1) / run)
    last = F.floor((F.col("_rank") - 1 + rows) / run)
    spread = base.select("*", first.alias("_own"), F.explode(F.sequence(first, last)).alias("_run"))
    in_run = Window.partitionBy("_run").orderBy("_rank")
    total = F.sum("_score").over(
        in_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        spread.withColumn("_total", total)
        .withColumn("_gone", F.coalesce(F.lag("_total", rows).over(in_run), F.lit(0.0)))
        .where(F.col("_own") == F.col("_run"))
        .select(
            "id",
            ts,
            (
                (F.col("_total") - F.col("_gone")) / F.least("_rank", F.lit(rows))
            ).alias("rolling_avg_score"),
            F.col("_rank"),
        )
    )


def events_per_second(scored: DataFrame, ts: str = "ts") -> DataFrame:
    """Events in each one-second tick that has any."""
    return (
        scored.groupBy(F.window(ts, "1 second").alias("_tick"))
        .agg(F.count("*").alias("events"))
        .select(F.col("_tick.start").alias("tick"), "events")
    )


def timeline(
    scored: DataFrame, ts: str = "ts", ticks: int = TIMELINE_TICKS, rows: int = ROLLING_SCORES
) -> DataFrame:
    """The latest ticks: event rate and the rolling mean score at the end of each.

    Only the events of these ticks and the ``rows`` events before them are averaged.
    """
    scored = stored(scored.select("id", ts, "anomaly_score"), "live-scores")
    rates = events_per_second(scored, ts).orderBy(F.desc("tick")).limit(ticks)
    cut = rates.agg(F.min("tick").alias("cut")).scalar()
    before = scored.where(F.col(ts) < cut).orderBy(F.desc(ts), F.desc("id")).limit(rows)
    recent = scored.where(F.col(ts) >= cut).unionByName(before)
    means = (
        rolling_avg_score(recent, ts, rows)
        .groupBy(F.window(ts, "1 second").alias("_tick"))
        .agg(F.max_by("rolling_avg_score", "_rank").alias("avg_score"))
        .select(F.col("_tick.start").alias("tick"), "avg_score")
    )
    return rates.join(means, "tick")


def event_table(
    scored: DataFrame,
    ip_part: str = "",
    min_score: float = 0.0,
    ts: str = "ts",
    rows: int = TABLE_ROWS,
) -> DataFrame:
    """Newest events whose address contains ``ip_part`` and that reach ``min_score``."""
    part = ip_part.strip()
    kept = scored.where(F.coalesce("anomaly_score", F.lit(0.0)) >= min_score)
    if part:
        kept = kept.where(F.col("source_ip").contains(part))
    return (
        kept.withColumn("score_band", table_band(F.col("anomaly_score")))
        .orderBy(F.desc(ts), F.desc("id"))
        .limit(rows)
    )


def alert_feed(
    scored: DataFrame, ts: str = "ts", rows: int = FEED_ROWS, settings: Settings = DEFAULTS
) -> DataFrame:
    return (
        scored.where(F.col("anomaly_score") >= settings.anomaly_threshold)
        .select(
            "id",
            ts,
            "source_ip",
            F.coalesce("path", F.lit("/")).alias("path"),
            "anomaly_score",
            F.coalesce("attack_type", F.lit("anomaly")).alias("alert_type"),
            alert_severity(F.col("anomaly_score")).alias("severity"),
        )
        .orderBy(F.desc(ts), F.desc("id"))
        .limit(rows)
    )


def running_totals(scored: DataFrame, ts: str = "ts", settings: Settings = DEFAULTS) -> DataFrame:
    """Events and alerts seen so far, after each event."""
    return ranked(scored, ts, settings).select(
        "id",
        ts,
        F.col("_rank").alias("events_so_far"),
        F.col("_alerts").alias("alerts_so_far"),
    )
