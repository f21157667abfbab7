"""Analyst feedback and the choice of training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
FEEDBACK_LABELS = ["normal", "false_positive"]
MIN_FEEDBACK = 50
MIN_TRAINING_ROWS = 100
MAX_TRAINING_ROWS = 10_000


def feedback_count(events: DataFrame, minimum: int = MIN_FEEDBACK) -> DataFrame:
    """Number of usable labels and whether it is enough to retrain."""
    return events.agg(
        F.count_if(F.col("label").isin(FEEDBACK_LABELS)).alias("feedback_events")
    ).withColumn("enough", F.col("feedback_events") >= minimum)


def training_rows(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Events that are normal or not labelled; with a limit, so many with the lowest ids."""
    rows = events.where(F.col("label").isNull() | (F.col("label") == "normal"))
    return rows if limit is None else rows.orderBy("id").limit(limit)
