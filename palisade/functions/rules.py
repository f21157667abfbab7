"""Flags, deterministic attack rules and the blend of rule and model scores."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.config import DEFAULTS

# Fixed values.
BRUTE_FORCE_FAILURES = 10
DDOS_BURST_RATE = 40.0
ANOMALY_TYPE_CUTOFF = 0.7
RULE_FLOOR = 0.9
SUSPICIOUS_PATH_SCORE = 0.8
AUTH_PATH_PARTS = ["/auth", "/login", "/ssh"]
SUSPICIOUS_PATH_KEYWORDS = [
    "admin", "shell", "passwd", "phpmyadmin", "cgi-bin",
    "..%2f", "../", ".env", "wp-admin", "debug",
]


def contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(or_, [text.contains(part) for part in parts])


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def effective_status(status: Column) -> Column:
    return F.coalesce(status, F.lit(0))


def is_post(method: Column) -> Column:
    return flag(F.upper(method) == "POST")


def is_auth_path(path: Column) -> Column:
    return flag(contains_any(path, AUTH_PATH_PARTS))


def status_is(status: Column, code: int) -> Column:
    return flag(effective_status(status) == code)


def brute_force(fail_count_1m: Column, is_auth: Column) -> Column:
    return (fail_count_1m >= BRUTE_FORCE_FAILURES) & (is_auth > 0)


def ddos_spike(burst_rate: Column) -> Column:
    return burst_rate >= DDOS_BURST_RATE


def suspicious_path(path: Column) -> Column:
    return contains_any(F.lower(path), SUSPICIOUS_PATH_KEYWORDS)


def rule_type(fail_count_1m: Column, is_auth: Column, burst_rate: Column, path: Column) -> Column:
    """Name of the first rule that holds, else null."""
    return (
        F.when(brute_force(fail_count_1m, is_auth), "brute_force")
        .when(ddos_spike(burst_rate), "ddos_spike")
        .when(suspicious_path(path), "suspicious_api")
    )


def rule_score(matched: Column) -> Column:
    """Score of a matched rule name."""
    return (
        F.when(matched.isin("brute_force", "ddos_spike"), F.lit(1.0))
        .when(matched == "suspicious_api", F.lit(SUSPICIOUS_PATH_SCORE))
        .otherwise(F.lit(0.0))
    )


def hybrid_score(
    ml_score: Column,
    rule: Column,
    ml_weight: float = DEFAULTS.ml_weight,
    rule_weight: float = DEFAULTS.rule_weight,
) -> Column:
    blended = F.greatest(
        F.lit(float(ml_weight)) * ml_score + F.lit(float(rule_weight)) * rule,
        rule * F.lit(RULE_FLOOR),
    )
    return F.least(F.when(rule > 0, blended).otherwise(ml_score), F.lit(1.0))


def hybrid_type(ml_score: Column, rule: Column, matched: Column) -> Column:
    """The rule's name; without one, ``anomaly`` for a model score strictly above 0.7."""
    return F.when(rule > 0, matched).when(ml_score > ANOMALY_TYPE_CUTOFF, "anomaly")
