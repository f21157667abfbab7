"""Listing, lookup, counting and analyst updates over the event and alert tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.schemas import EVENT_LABELS, EVENT_REQUIRED, EVENT_TEXT_LIMITS, IP_TAGS

# Paging bounds.
DEFAULT_LIMIT = 50
MAX_LIMIT = 200

_INT_RANGE = (-(2**31), 2**31 - 1)


def check_page(skip: int, limit: int) -> None:
    if skip < 0:
        raise ValueError("skip must not be negative")
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")


def page_accepted(skip: Column, limit: Column) -> Column:
    """:func:`check_page` for columns."""
    return (skip >= 0) & limit.between(1, MAX_LIMIT)


def _newest(table: DataFrame, skip: int, limit: int) -> DataFrame:
    # The id only makes the order of rows with equal times repeatable.
    return table.orderBy(F.desc("created_at"), "id").offset(skip).limit(limit)


def list_events(
    events: DataFrame,
    skip: int = 0,
    limit: int = DEFAULT_LIMIT,
    source_ip: str | None = None,
    min_score: float | None = None,
    attack_type: str | None = None,
) -> DataFrame:
    check_page(skip, limit)
    if source_ip:
        events = events.where(F.col("source_ip") == source_ip)
    if min_score is not None:
        events = events.where(F.col("anomaly_score") >= min_score)
    if attack_type:
        events = events.where(F.col("attack_type") == attack_type)
    return _newest(events, skip, limit)


def event_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count("id").alias("count"))


def get_event(events: DataFrame, event_id: int) -> DataFrame:
    return events.where(F.col("id") == event_id)


def valid_labels(updates: DataFrame) -> Column:
    return F.coalesce(updates["label"].isin(EVENT_LABELS), F.lit(False))


def valid_tags(updates: DataFrame) -> Column:
    return F.coalesce(updates["tag"].isin(IP_TAGS), F.lit(False))


def label_events(events: DataFrame, updates: DataFrame) -> DataFrame:
    """Applies the latest valid update (event_id, label, labelled_at) of each event."""
    latest = (
        updates.where(valid_labels(updates))
        .groupBy(F.col("event_id").alias("id"))
        .agg(F.max_by("label", F.struct("labelled_at", "label")).alias("_label"))
    )
    return events.join(latest, "id", "left").select(
        *[
            F.coalesce("_label", "label").alias("label") if name == "label" else F.col(name)
            for name in events.columns
        ]
    )


def unknown_labels(events: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates of events that do not exist."""
    return updates.join(events.select(F.col("id").alias("event_id")), "event_id", "left_anti")


def list_alerts(
    alerts: DataFrame,
    skip: int = 0,
    limit: int = DEFAULT_LIMIT,
    severity: str | None = None,
    resolved: bool | None = None,
) -> DataFrame:
    check_page(skip, limit)
    if severity:
        alerts = alerts.where(F.col("severity") == severity)
    if resolved is not None:
        alerts = alerts.where(F.col("resolved") == resolved)
    return _newest(alerts, skip, limit)


def alert_stats(alerts: DataFrame) -> DataFrame:
    open_alert = ~F.col("resolved")
    return alerts.agg(
        F.count("*").alias("total_alerts"),
        F.count_if(open_alert).alias("active_alerts"),
        F.count_if(open_alert & (F.col("severity") == "critical")).alias("critical_active"),
    )


def resolve_alerts(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Applies the latest resolution of each alert.

    ``resolutions`` is (alert_id, resolved_by, resolved_at, is_false_positive); a null
    ``resolved_by`` means ``analyst``, a null flag means false.
    """
    latest = resolutions.groupBy(F.col("alert_id").alias("id")).agg(
        F.max_by(
            F.struct(
                F.coalesce("resolved_by", F.lit("analyst")).alias("by"),
                F.col("resolved_at").alias("time"),
                F.coalesce("is_false_positive", F.lit(False)).alias("fp"),
            ),
            F.struct("resolved_at", "resolved_by"),
        ).alias("_last")
    )
    hit = F.col("_last").isNotNull()
    changed = {
        "resolved": hit | F.col("resolved"),
        "resolved_by": F.when(hit, F.col("_last.by")).otherwise(F.col("resolved_by")),
        "resolved_at": F.when(hit, F.col("_last.time")).otherwise(F.col("resolved_at")),
        "is_false_positive": F.when(hit, F.col("_last.fp")).otherwise(
            F.col("is_false_positive")
        ),
    }
    return alerts.join(latest, "id", "left").select(
        *[changed.get(name, F.col(name)).alias(name) for name in alerts.columns]
    )


def label_false_positives(events: DataFrame, resolved_alerts: DataFrame) -> DataFrame:
    """Labels the source events of alerts that were resolved as false positives."""
    wrong = (
        resolved_alerts.where(F.col("resolved") & F.col("is_false_positive"))
        .select(F.col("event_id").alias("id"))
        .distinct()
        .withColumn("_label", F.lit("false_positive"))
    )
    return events.join(wrong, "id", "left").select(
        *[
            F.coalesce("_label", "label").alias("label") if name == "label" else F.col(name)
            for name in events.columns
        ]
    )


def overview(
    events: DataFrame, alerts: DataFrame, reputation: DataFrame, model_version: str | None = None
) -> DataFrame:
    """One row of totals over the three tables."""
    alert_totals = alerts.agg(
        F.struct(
            F.count("*").alias("total"), F.count_if(~F.col("resolved")).alias("active")
        ).alias("totals")
    ).scalar()
    blocked = reputation.agg(F.count_if(F.col("tag") == "blocked").alias("blocked")).scalar()
    return events.agg(
        F.count("*").alias("total_events"), F.avg("anomaly_score").alias("avg_anomaly_score")
    ).select(
        "total_events",
        alert_totals["total"].alias("total_alerts"),
        alert_totals["active"].alias("active_alerts"),
        blocked.alias("blocked_ips"),
        "avg_anomaly_score",
        F.lit(model_version).cast("string").alias("model_version"),
    )


def event_alerts(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts with their source event."""
    source = events.select(
        F.col("id").alias("event_id"), "source_ip", "path", "anomaly_score"
    )
    return alerts.join(source, "event_id")


def orphan_alerts(events: DataFrame, alerts: DataFrame) -> DataFrame:
    return alerts.join(events.select(F.col("id").alias("event_id")), "event_id", "left_anti")


def limit_violation(columns: list[str]) -> Column:
    """First table constraint a row would break, else null. Checks the columns that are there."""
    reasons = [
        F.when(F.col(name).isNull(), f"null {name}") for name in EVENT_REQUIRED if name in columns
    ]
    reasons += [
        F.when(F.length(name) > limit, f"{name} longer than {limit}")
        for name, limit in EVENT_TEXT_LIMITS.items()
        if name in columns
    ]
    if "status_code" in columns:
        reasons.append(
            F.when(~F.col("status_code").between(*_INT_RANGE), "status_code out of range")
        )
    return F.coalesce(*reasons)
