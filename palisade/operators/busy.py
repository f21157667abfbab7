"""Window features for addresses that send more than one task should take in a slice.

Frames are whole seconds long, so an event's frame starts at the same fraction of a second as the
event itself. Splitting time into seconds, a count is

* the totals of the seconds from ``ts - w`` on, which come from a table of one row per second,
* less the events of that first second that precede the frame, plus those of the event's own second.

Only the second part needs single events, of the two seconds concerned. Each event is therefore
sent to its own second and, without wide columns, to those 5, 60 and 300 seconds later. A task
never needs more than four seconds of an address.

The totals are a prefix scan on two levels: running totals within blocks of ``BLOCK`` seconds, and
running totals of the blocks, of which an address has some 30,000 a year. Neighbours on a path are
looked for within a block and the minute around it. A reset starts a new era of its address: the
number of resets before a second comes from the same scan, those within the second from its events;
all totals are per era.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import rules
from palisade.functions.time import MICROS, epoch_micros, time_slice
from palisade.operators.features import BURST, FIVE_MINUTES, MINUTE
from palisade.session import stored

_OWN = 0
_ERA = ["source_ip", "_era"]
_PER_SECOND = [*_ERA, "_second"]
#: Seconds of a block of the prefix scan.
BLOCK = 1024


def busy_addresses(log: DataFrame, ts: str, slice_seconds: int, rows: int) -> DataFrame:
    """Addresses with more than ``rows`` events in a slice; at most one per ``rows`` of the log."""
    return (
        log.select("source_ip", time_slice(epoch_micros(F.col(ts)), slice_seconds).alias("_slice"))
        .groupBy("source_ip", "_slice")
        .count()
        .where(F.col("count") > rows)
        .select("source_ip")
        .distinct()
    )


def _block(second: Column) -> Column:
    """Number of the block that a time in microseconds falls in."""
    return F.floor(second / (BLOCK * MICROS)).cast("bigint")


def _scanned(seconds: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``keys, _second`` and, for each value, its total over all earlier seconds as ``value_before``."""
    blocked = seconds.withColumn("_block", _block(F.col("_second")))
    blocks = blocked.groupBy(*keys, "_block").agg(*[F.sum(v).alias(v) for v in values])
    earlier = blocks.select(
        *keys, "_block",
        *[_running(F.col(v), "_block", keys, -1).alias(f"{v}_blocks") for v in values],
    )
    inside = blocked.select(
        *keys, "_second", "_block",
        *[_running(F.col(v), "_second", [*keys, "_block"], -1).alias(f"{v}_inside") for v in values],
    )
    return inside.join(earlier, [*keys, "_block"]).select(
        *keys, "_second", *[F.expr(f"{v}_blocks + {v}_inside").alias(f"{v}_before") for v in values])


def _with_eras(events: DataFrame, resets: DataFrame | None) -> DataFrame:
    """Adds ``_era``: how many resets of the address came before the event."""
    if resets is None:
        return events.withColumn("_era", F.lit(0).cast("bigint"))
    micros = epoch_micros(F.col("reset_at"))
    marks = resets.select(
        "source_ip", micros.alias("_us"), time_slice(micros, 1).alias("_second"),
        F.lit(1).cast("bigint").alias("_reset"))
    both = events.withColumn("_reset", F.lit(0).cast("bigint")).unionByName(marks, allowMissingColumns=True)
    second = ["source_ip", "_second"]
    before = _scanned(
        both.groupBy(*second).agg(F.sum("_reset").alias("_reset")), ["source_ip"], ["_reset"])
    within = both.repartition(*second).withColumn("_within", _running(F.col("_reset"), "_us", second, -1))
    return (
        within.where("_reset = 0").join(before, second)
        .withColumn("_era", F.col("_within") + F.col("_reset_before"))
        .drop("_reset", "_within", "_reset_before")
    )


def _neighbours(events: DataFrame) -> DataFrame:
    """Per address, second and path one event of the nearest earlier and later second on the path, as
    far as it lies within a minute or so."""
    minute = (MINUTE + 2) * MICROS
    home, second = _block(F.col("_second")), F.col("_second")
    first_last = events.groupBy(*_PER_SECOND, "path").agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_last"))
    # Blocks that the second belongs to, or is within a minute of.
    near = F.array_distinct(F.array(_block(second - minute), home, _block(second + minute)))
    in_order = Window.partitionBy(*_ERA, "path", "_block").orderBy("_second")
    return (
        first_last.select("*", F.explode(near).alias("_block"))
        .withColumn("_near", F.array(F.lag("_last").over(in_order), F.lead("_first").over(in_order)))
        .where(F.col("_block") == home)
        .select(*_PER_SECOND, "path", F.explode("_near").alias("_us"))
        .where(F.col("_us").isNotNull())
    )


def _flagged(log: DataFrame, ts: str, resets: DataFrame | None) -> DataFrame:
    """Events with whether they replace, within a minute, an event on their path, and whether
    they lapse before the next one. Neighbours in other seconds are represented by one row each."""
    micros = epoch_micros(F.col(ts))
    status = rules.effective_status(F.col("status_code")).cast("bigint")
    events = _with_eras(log.select(
        "source_ip",
        "path",
        micros.alias("_us"),
        time_slice(micros, 1).alias("_second"),
        status.alias("_status"),
        (status >= 400).cast("bigint").alias("_fail"),
        F.struct(*log.columns).alias("_row"),
    ), resets)
    together = events.unionByName(
        _neighbours(events), allowMissingColumns=True).repartition(*_PER_SECOND)
    on_path = Window.partitionBy(*_PER_SECOND, "path").orderBy("_us")
    minute = MINUTE * MICROS
    replaces = F.coalesce(F.col("_us") - F.lag("_us").over(on_path) <= minute, F.lit(False))
    lapses = F.coalesce(F.lead("_us").over(on_path) - F.col("_us") > minute, F.lit(True))
    return (
        together.withColumns(
            {"_standing": 1 - replaces.cast("bigint"), "_lapses": lapses.cast("bigint")}
        )
        .where(F.col("_row").isNotNull())
        .withColumn("_one", F.lit(1).cast("bigint"))
    )


_VALUES = ["_one", "_fail", "_status", "_standing", "_lapses"]
# The frame lengths for which the earlier total of each value is needed.
_FRAMES = {
    "_one": [BURST, MINUTE, FIVE_MINUTES],
    "_fail": [MINUTE, FIVE_MINUTES],
    "_status": [MINUTE],
    "_lapses": [MINUTE],
}


def _running(value: Column, order: str, keys: list[str], end: int) -> Column:
    frame = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, end)
    return F.coalesce(F.sum(value).over(frame), F.lit(0))


def busy_counts(log: DataFrame, ts: str = "ts", resets: DataFrame | None = None) -> DataFrame:
    """Adds the seven window features, like ``sliding_counts``, in pieces of single seconds."""
    flagged = stored(_flagged(log, ts, resets), "busy-addresses")
    seconds = flagged.groupBy(*_PER_SECOND).agg(*[F.sum(name).alias(name) for name in _VALUES])
    # The totals of a second count from the next one on and, once more, from ``frame`` seconds later.
    late = {f"{name}_{frame}": (name, frame) for name, frames in _FRAMES.items() for frame in frames}
    shifted = seconds.select(
        "*", F.explode(F.array(*map(F.lit, (_OWN, BURST, MINUTE, FIVE_MINUTES)))).alias("_shift")
    ).select(
        *_ERA,
        (F.col("_second") + F.col("_shift") * MICROS).alias("_second"),
        *[F.when(F.col("_shift") == _OWN, F.col(name)).alias(name) for name in _VALUES],
        *[F.when(F.col("_shift") == frame, F.col(name)).alias(as_name)
          for as_name, (name, frame) in late.items()],
    )
    columns = [*_VALUES, *late]
    before = _scanned(
        shifted.groupBy(*_PER_SECOND).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]),
        _ERA, columns,
    )
    shift = F.col("_shift") * MICROS
    copies = flagged.select(
        "*", F.explode(F.array(*map(F.lit, (_OWN, BURST, MINUTE, FIVE_MINUTES)))).alias("_shift")
    ).select(
        *_ERA,
        (F.col("_second") + shift).alias("_second"),
        (F.col("_us") + shift).alias("_us"),
        "_shift",
        *_VALUES,
        F.when(F.col("_shift") == _OWN, F.col("_row")).alias("_row"),
    )

    def of(name: str, part: int) -> Column:
        return F.when(F.col("_shift") == part, F.col(name))

    inside = copies.repartition(*_PER_SECOND).select(
        *_PER_SECOND,
        "_row",
        *[_running(of(name, _OWN), "_us", _PER_SECOND, 0).alias(f"{name}_upto") for name in _VALUES],
        *[
            _running(of(name, frame), "_us", _PER_SECOND, -1).alias(f"{name}_gone_{frame}")
            for name, frames in _FRAMES.items()
            for frame in frames
        ],
    )
    joined = inside.where(F.col("_row").isNotNull()).join(before, _PER_SECOND)

    def upto(name: str) -> Column:
        return F.col(f"{name}_before") + F.col(f"{name}_upto")

    def gone(name: str, frame: int) -> Column:
        return F.col(f"{name}_{frame}_before") + F.col(f"{name}_gone_{frame}")

    def within(name: str, frame: int) -> Column:
        return upto(name) - gone(name, frame)

    return joined.select(
        "_row.*",
        within("_one", MINUTE).alias("ip_req_count_1m"),
        within("_one", FIVE_MINUTES).alias("ip_req_count_5m"),
        within("_fail", MINUTE).alias("ip_fail_count_1m"),
        within("_fail", FIVE_MINUTES).alias("ip_fail_count_5m"),
        (upto("_standing") - gone("_lapses", MINUTE)).alias("unique_paths_1m"),
        (within("_status", MINUTE) / within("_one", MINUTE)).alias("avg_status_code_1m"),
        (within("_one", BURST) / F.lit(float(BURST))).alias("burst_rate"),
    )
