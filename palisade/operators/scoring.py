"""Rules and score modes over a table with features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import DEFAULTS, Settings
from palisade.functions import rules, scoring


def apply_rules(featured: DataFrame) -> DataFrame:
    """Adds ``rule_type`` (first matching rule) and ``rule_score``."""
    matched = rules.rule_type(
        F.col("ip_fail_count_1m"), F.col("is_auth_endpoint"), F.col("burst_rate"), F.col("path")
    )
    return featured.withColumn("rule_type", matched).withColumn(
        "rule_score", rules.rule_score(F.col("rule_type"))
    )


def hybrid(
    featured: DataFrame, ml_score: Column, settings: Settings = DEFAULTS
) -> DataFrame:
    """Adds ``anomaly_score`` and ``attack_type`` from rules and a model score."""
    ruled = apply_rules(featured.withColumn("_ml", ml_score))
    ml, rule = F.col("_ml"), F.col("rule_score")
    return ruled.select(
        *featured.columns,
        rules.hybrid_score(ml, rule, settings.ml_weight, settings.rule_weight).alias(
            "anomaly_score"
        ),
        rules.hybrid_type(ml, rule, F.col("rule_type")).alias("attack_type"),
    )


def score_events(
    featured: DataFrame,
    mode: str = "hybrid",
    iforest: Column | None = None,
    autoencoder: Column | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Adds ``anomaly_score`` and ``attack_type`` in the chosen mode.

    ``iforest`` and ``autoencoder`` are the model score columns; a model that is not fitted, or
    not given, scores 0.5. An unknown mode scores 0.5 without a type.
    """
    unfitted = F.lit(scoring.UNFITTED_SCORE)
    first = unfitted if iforest is None else iforest
    second = unfitted if autoencoder is None else autoencoder
    if mode == "hybrid":
        return hybrid(featured, scoring.ensemble_score(first, second), settings)
    if mode not in ("iforest", "autoencoder"):
        return featured.withColumns(
            {"anomaly_score": unfitted, "attack_type": F.lit(None).cast("string")}
        )
    scored = featured.withColumn("anomaly_score", first if mode == "iforest" else second)
    return scored.withColumn(
        "attack_type", F.when(F.col("anomaly_score") > settings.anomaly_threshold, "anomaly")
    )


def minmax_scores(decisions: DataFrame, decision: str, scope: str = "batch") -> Column:
    """Score column for a decision-value column of ``decisions``.

    ``scope='batch'`` takes minimum and maximum over the whole table, as a scalar subquery.
    ``scope='row'`` treats every row as a batch of its own, where minimum, maximum and value
    coincide and the score is 1.
    """
    if scope == "row":
        return F.when(F.col(decision).isNotNull(), F.lit(1.0))
    if scope != "batch":
        raise ValueError(f"scope must be 'batch' or 'row', not {scope!r}")
    bounds = decisions.agg(
        F.struct(F.min(decision).alias("low"), F.max(decision).alias("high")).alias("bounds")
    ).scalar()
    return scoring.inverted_minmax(F.col(decision), bounds["low"], bounds["high"])
