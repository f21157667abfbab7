"""Sliding-window features per source address.

Every frame is closed at both ends, ``[ts - w, ts]``, and holds the event itself with all events
of the same address and time.

A plain ``RANGE BETWEEN w PRECEDING AND CURRENT ROW`` frame has two costs at scale: Spark walks
the whole frame again for each row, and a busy address lands in one task. Both are avoided here:

* A window count is the difference of two *running* counts, "up to ts" minus "before ts - w".
  Frames that start at UNBOUNDED PRECEDING are advanced row by row, so the work per row does not
  depend on how many events a frame holds.
* Each address is cut into time slices and the shuffle key is (address, slice). Rows of the last
  five minutes of a slice are also sent, as context and without their wide columns, to the next
  slice, and dropped again after the windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.config import DEFAULTS
from palisade.functions import rules
from palisade.functions.time import MICROS, epoch_micros, time_slice
from palisade.schemas import FEATURE_NAMES
from palisade.session import stored

# Frame lengths in seconds.
MINUTE = 60
FIVE_MINUTES = 300
BURST = 5

_NEEDED = ["source_ip", "path", "status_code", "_reset"]


def event_defaults(log: DataFrame) -> DataFrame:
    """Missing status becomes 0 and the method is upper-cased, as features and rules read them."""
    return log.withColumns(
        {
            "status_code": rules.effective_status(F.col("status_code")),
            "method": F.upper("method"),
        }
    )


def with_slices(log: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Adds ``_us``, ``_slice`` and ``_context`` and repeats each slice's tail in the next slice."""
    if seconds < FIVE_MINUTES:
        raise ValueError(f"slices must be at least {FIVE_MINUTES} s long")
    timed = log.withColumn("_us", epoch_micros(F.col(ts)))
    slice_of = time_slice(F.col("_us"), seconds)
    reaches_next = time_slice(F.col("_us") + FIVE_MINUTES * MICROS, seconds) > slice_of
    copies = F.when(reaches_next, F.array(F.lit(False), F.lit(True))).otherwise(
        F.array(F.lit(False))
    )
    spread = timed.select("*", F.explode(copies).alias("_context"))
    kept = [*_NEEDED, "_us", "_context"]
    return spread.select(
        *kept,
        *[
            F.when(~F.col("_context"), F.col(name)).alias(name)
            for name in log.columns
            if name not in kept
        ],
        F.when(F.col("_context"), slice_of + seconds * MICROS).otherwise(slice_of).alias("_slice"),
    ).repartition("source_ip", "_slice")


def _running(value: str, seconds: int | None = None) -> Column:
    """Running total up to the row's time, or up to just before ``seconds`` earlier."""
    ordered = Window.partitionBy("source_ip", "_slice", "_era").orderBy("_us")
    end = 0 if seconds is None else -(seconds * MICROS + 1)
    return F.coalesce(
        F.sum(value).over(ordered.rangeBetween(Window.unboundedPreceding, end)), F.lit(0)
    )


def with_resets(log: DataFrame, resets: DataFrame | None, ts: str = "ts") -> DataFrame:
    """Adds the resets (source_ip, reset_at) as rows marked ``_reset``."""
    if resets is None:
        return log.withColumn("_reset", F.lit(0))
    marks = resets.select("source_ip", F.col("reset_at").alias(ts), F.lit(1).alias("_reset"))
    return log.withColumn("_reset", F.lit(0)).unionByName(marks, allowMissingColumns=True)


def with_eras(sliced: DataFrame, resets: DataFrame | None) -> DataFrame:
    """Adds ``_era``, the number of earlier resets, and drops the rows that mark resets."""
    if resets is None:
        return sliced.withColumn("_era", F.lit(0))
    earlier = (
        Window.partitionBy("source_ip", "_slice")
        .orderBy("_us")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    era = F.coalesce(F.sum("_reset").over(earlier), F.lit(0))
    return sliced.withColumn("_era", era).where(F.col("_reset") == 0)


def sliding_counts(
    log: DataFrame,
    ts: str = "ts",
    slice_seconds: int = DEFAULTS.window_slice_seconds,
    resets: DataFrame | None = None,
    busy_rows: int | None = DEFAULTS.busy_rows,
) -> DataFrame:
    """Adds the seven window features to each log row.

    ``resets`` lists (source_ip, reset_at); frames never reach back over a reset. Addresses with more
    than ``busy_rows`` events in one slice are split by the second, with equal results; they are looked
    up in a pass over addresses and times of ``log``, which should be a stored table. None leaves that
    out, for logs that are known to have no such address.

    Distinct paths: an event stands for its path from its own time until the next event on that
    path, or for one minute when there is none by then. The number of distinct paths at ``ts`` is
    the number of events standing at that moment, again a difference of running totals.
    """
    if busy_rows is not None:
        from palisade.operators.busy import busy_addresses, busy_counts

        busy = busy_addresses(log, ts, slice_seconds, busy_rows)
        if not busy.isEmpty():
            busy = stored(busy, "busy-list")
            others = log.join(busy, "source_ip", "left_anti").select(*log.columns)
            split = busy_counts(log.join(busy, "source_ip", "left_semi").select(*log.columns), ts, resets)
            return sliding_counts(others, ts, slice_seconds, resets, None).unionByName(split)
    sliced = with_eras(with_slices(with_resets(log, resets, ts), ts, slice_seconds), resets)
    by_path = Window.partitionBy("source_ip", "_slice", "_era", "path").orderBy("_us")
    minute = MINUTE * MICROS
    marked = sliced.select(
        "*",
        F.lit(1).cast("bigint").alias("_one"),
        rules.effective_status(F.col("status_code")).cast("bigint").alias("_status"),
        (rules.effective_status(F.col("status_code")) >= 400).cast("bigint").alias("_fail"),
        F.coalesce(F.col("_us") - F.lag("_us").over(by_path) <= minute, F.lit(False))
        .cast("bigint")
        .alias("_replaces"),
        F.coalesce(F.lead("_us").over(by_path) - F.col("_us") > minute, F.lit(True))
        .cast("bigint")
        .alias("_lapses"),
    )
    # Named first, so that each running total is computed once.
    running = marked.select(
        "*",
        _running("_one").alias("_n"),
        _running("_one", BURST).alias("_n_5s"),
        _running("_one", MINUTE).alias("_n_1m"),
        _running("_one", FIVE_MINUTES).alias("_n_5m"),
        _running("_fail").alias("_f"),
        _running("_fail", MINUTE).alias("_f_1m"),
        _running("_fail", FIVE_MINUTES).alias("_f_5m"),
        _running("_status").alias("_s"),
        _running("_status", MINUTE).alias("_s_1m"),
        _running("_replaces").alias("_r"),
        _running("_lapses", MINUTE).alias("_l_1m"),
    )
    windowed = running.select(
        "*",
        F.expr("_n - _n_1m").alias("ip_req_count_1m"),
        F.expr("_n - _n_5m").alias("ip_req_count_5m"),
        F.expr("_f - _f_1m").alias("ip_fail_count_1m"),
        F.expr("_f - _f_5m").alias("ip_fail_count_5m"),
        F.expr("_n - _r - _l_1m").alias("unique_paths_1m"),
        F.expr("(_s - _s_1m) / (_n - _n_1m)").alias("avg_status_code_1m"),
        ((F.col("_n") - F.col("_n_5s")) / F.lit(float(BURST))).alias("burst_rate"),
    )
    counts = [
        "ip_req_count_1m",
        "ip_req_count_5m",
        "ip_fail_count_1m",
        "ip_fail_count_5m",
        "unique_paths_1m",
        "avg_status_code_1m",
        "burst_rate",
    ]
    return windowed.where(~F.col("_context")).select(*log.columns, *counts)


def binary_flags(log: DataFrame) -> DataFrame:
    """Adds the five 0/1 features that depend on the event alone."""
    status = F.col("status_code")
    return log.withColumns(
        {
            "is_post": rules.is_post(F.col("method")),
            "is_auth_endpoint": rules.is_auth_path(F.col("path")),
            "status_is_401": rules.status_is(status, 401),
            "status_is_403": rules.status_is(status, 403),
            "status_is_500": rules.status_is(status, 500),
        }
    )


def feature_vector(featured: DataFrame) -> DataFrame:
    """Adds ``features``: the twelve numbers in fixed order as 32-bit floats."""
    return featured.withColumn(
        "features", F.array(*[F.col(name).cast("float") for name in FEATURE_NAMES])
    )


def with_features(
    log: DataFrame,
    ts: str = "ts",
    slice_seconds: int = DEFAULTS.window_slice_seconds,
    resets: DataFrame | None = None,
    busy_rows: int | None = DEFAULTS.busy_rows,
) -> DataFrame:
    return feature_vector(
        binary_flags(sliding_counts(log, ts, slice_seconds, resets, busy_rows))
    )
