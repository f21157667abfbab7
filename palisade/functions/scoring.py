"""Bands over scores and the normalisations that turn model output into a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEVERITY_BANDS = [(0.95, "critical"), (0.85, "high"), (0.7, "medium")]
TABLE_BANDS = [(0.9, "critical"), (0.7, "high"), (0.5, "medium")]
BLOCKED_AT_MOST = 0.25
SUSPICIOUS_AT_MOST = 0.45
UNFITTED_SCORE = 0.5
EPSILON = 1e-8


def _band(score: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    first, *rest = bands
    chain = F.when(score >= first[0], first[1])
    for lower, name in rest:
        chain = chain.when(score >= lower, name)
    return chain.otherwise(otherwise)


def alert_severity(score: Column) -> Column:
    return _band(score, SEVERITY_BANDS, "low")


def table_band(score: Column) -> Column:
    return _band(F.coalesce(score, F.lit(0.0)), TABLE_BANDS, "low")


def reputation_tag(score: Column) -> Column:
    return (
        F.when(score <= BLOCKED_AT_MOST, "blocked")
        .when(score <= SUSPICIOUS_AT_MOST, "suspicious")
        .otherwise("trusted")
    )


def clip_unit(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def inverted_minmax(decision: Column, low: Column, high: Column) -> Column:
    """Lowest decision value of the scored set becomes 1, the highest about 0."""
    return clip_unit(F.lit(1.0) - (decision - low) / ((high - low) + F.lit(EPSILON)))


def error_score(error: Column, threshold: Column) -> Column:
    """Reconstruction error at twice the training threshold, or more, becomes 1."""
    return clip_unit(error / (threshold * F.lit(2.0) + F.lit(EPSILON)))


def ensemble_score(first: Column, second: Column) -> Column:
    return (first + second) / F.lit(2.0)
