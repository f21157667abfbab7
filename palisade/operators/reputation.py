"""Reputation per address: an exponentially weighted mean of ``1 - score``.

With weight a for the newest event, m events turn an old value r into
``(1-a)^m * r + sum(a * (1-a)^(m-k) * c_k)``. The pair (m, sum) of a stretch of events is all that
later steps need, and pairs of consecutive stretches combine. So an address is summed up per second
first, then its seconds per minute, its minutes per hour and its hours; no task orders more than the
events of one second or the few stretches of one level. A micro-batch is a stretch as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.config import DEFAULTS, Settings
from palisade.functions.scoring import reputation_tag
from palisade.functions.time import epoch_micros, time_slice
from palisade.schemas import IP_TAGS


def _decay(events: Column, settings: Settings) -> Column:
    return F.pow(F.lit(1.0 - settings.ewma_alpha), events)


def combine_stretches(
    stretches: DataFrame, order: str, settings: Settings = DEFAULTS, within: str | None = None
) -> DataFrame:
    """One stretch per address, or per address and ``within``, from consecutive ones in ``order``."""
    keys = ["ip", within] if within else ["ip"]
    later = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    after = F.coalesce(
        F.sum("events").over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        stretches.withColumn("_after", after)
        .groupBy(*keys)
        .agg(
            F.sum("events").alias("events"),
            F.sum("alerts").alias("alerts"),
            F.sum("anomaly_sum").alias("anomaly_sum"),
            F.sum(F.col("weighted") * _decay(F.col("_after"), settings)).alias("weighted"),
            F.min_by("first_contribution", order).alias("first_contribution"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
        )
    )


def summarise_events(
    scored: DataFrame, ts: str = "ts", settings: Settings = DEFAULTS
) -> DataFrame:
    """One stretch per address from scored events in ``(ts, id)`` order."""
    score = F.col("anomaly_score")
    micros = epoch_micros(F.col(ts))
    events = scored.select(
        F.col("source_ip").alias("ip"),
        "id",
        F.col(ts).alias("_ts"),
        score,
        time_slice(micros, settings.fold_seconds[0]).alias("_slice"),
    )
    newest_first = Window.partitionBy("ip", "_slice").orderBy(F.desc("_ts"), F.desc("id"))
    contribution = F.lit(1.0) - score
    stretches = (
        events.withColumn("_after", F.row_number().over(newest_first) - 1)
        .groupBy("ip", "_slice")
        .agg(
            F.count("*").alias("events"),
            F.count_if(score >= settings.anomaly_threshold).alias("alerts"),
            F.sum(score).alias("anomaly_sum"),
            F.sum(
                F.lit(settings.ewma_alpha) * _decay(F.col("_after"), settings) * contribution
            ).alias("weighted"),
            F.max_by(contribution, "_after").alias("first_contribution"),
            F.min("_ts").alias("first_seen"),
            F.max("_ts").alias("last_seen"),
        )
    )
    for seconds in settings.fold_seconds[1:]:
        longer = stretches.withColumn("_longer", time_slice(F.col("_slice"), seconds))
        stretches = combine_stretches(longer, "_slice", settings, within="_longer")
        stretches = stretches.withColumnRenamed("_longer", "_slice")
    return combine_stretches(stretches, "_slice", settings)


def merge_reputation(
    known: DataFrame, stretches: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Reputation table after the events summed up in ``stretches``; one row per address each."""
    old, new = known.alias("old"), stretches.alias("new")
    score = F.when(F.col("new.ip").isNull(), F.col("old.reputation_score")).otherwise(
        F.col("new.weighted")
        + _decay(F.col("new.events"), settings)
        * F.coalesce("old.reputation_score", "new.first_contribution")
    )

    def total(old_name: str, new_name: str) -> Column:
        zero = F.lit(0)
        return F.coalesce(F.col(f"old.{old_name}"), zero) + F.coalesce(
            F.col(f"new.{new_name}"), zero
        )

    merged = old.join(new, F.col("old.ip") == F.col("new.ip"), "full_outer").select(
        F.coalesce("old.ip", "new.ip").alias("ip"),
        total("total_events", "events").alias("total_events"),
        total("total_alerts", "alerts").alias("total_alerts"),
        total("anomaly_sum", "anomaly_sum").alias("anomaly_sum"),
        score.alias("reputation_score"),
        F.when(F.col("new.ip").isNull(), F.col("old.tag")).alias("_kept_tag"),
        F.least("old.first_seen", "new.first_seen").alias("first_seen"),
        F.greatest("old.last_seen", "new.last_seen").alias("last_seen"),
    )
    return _tagged(merged, F.col("_kept_tag"))


def _tagged(table: DataFrame, kept: Column | None = None) -> DataFrame:
    computed = reputation_tag(F.col("reputation_score"))
    return table.select(
        "ip",
        "total_events",
        "total_alerts",
        "anomaly_sum",
        "reputation_score",
        (computed if kept is None else F.coalesce(kept, computed)).alias("tag"),
        "first_seen",
        "last_seen",
    )


def first_reputation(stretches: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Reputation of addresses that were not known before; the first event seeds the mean."""
    return _tagged(
        stretches.select(
            "ip",
            F.col("events").alias("total_events"),
            F.col("alerts").alias("total_alerts"),
            "anomaly_sum",
            (
                F.col("weighted")
                + _decay(F.col("events"), settings) * F.col("first_contribution")
            ).alias("reputation_score"),
            "first_seen",
            "last_seen",
        )
    )


def reputation(scored: DataFrame, ts: str = "ts", settings: Settings = DEFAULTS) -> DataFrame:
    return first_reputation(summarise_events(scored, ts, settings), settings)


def reputation_lookup(table: DataFrame, ip: str) -> DataFrame:
    return table.where(F.col("ip") == ip)


def override_tags(table: DataFrame, overrides: DataFrame) -> DataFrame:
    """Applies the latest override (ip, tag, override_ts) of each address.

    Overrides with a tag of no known kind don't count; of several at one time the greatest tag holds.
    An override holds until the address's next event. Overrides of unknown addresses have no
    row to apply to; see :func:`unknown_overrides`.
    """
    latest = (
        overrides.where(F.col("tag").isin(IP_TAGS) & F.col("override_ts").isNotNull())
        .groupBy("ip").agg(F.max(F.struct("override_ts", "tag")).alias("_last"))
        .select("ip", F.col("_last.tag").alias("_tag"), F.col("_last.override_ts").alias("_at"))
    )
    holds = F.col("_at") >= F.col("last_seen")
    return table.join(latest, "ip", "left").select(
        *[
            F.when(holds, F.col("_tag")).otherwise(F.col("tag")).alias("tag")
            if name == "tag"
            else F.col(name)
            for name in table.columns
        ]
    )


def unknown_overrides(table: DataFrame, overrides: DataFrame) -> DataFrame:
    return overrides.join(table.select("ip"), "ip", "left_anti")
