"""Alert candidates, the cooldown gate and alert rows.

The cooldown is a sequential rule: after an alert fires, events of the same address and type stay
silent until 60 s later, and silent events do not extend the pause. To run it without sending all
events of a busy address to one task, each (address, type) is cut into time slices:

1. Per slice: the map from the moment from which alerts may fire when the slice is entered to that
   moment when it is left. Such a map is a step function. Every Arrow batch of a slice is one more
   stretch of time, and its map is composed with that of the stretches before, so a slice of any size
   passes through in batches. Only entry states within the first minute can occur, so the map has no
   more steps than the slice has candidates in that minute: two whole numbers each.
2. Per (address, type): walk those short tables in time order to fix each slice's entry state.
3. Per slice: fire alerts from the known entry state, which is carried from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import DEFAULTS, Settings
from palisade.functions.scoring import alert_severity
from palisade.functions.text import three_decimals
from palisade.functions.time import MICROS, epoch_micros, time_slice
from palisade.session import stored

_KEY = ["source_ip", "alert_type"]
_SLICE = [*_KEY, "_slice"]
_ALWAYS = -(2**62)


def alert_candidates(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Events at or above the threshold; a missing type counts as ``anomaly``."""
    return scored.where(F.col("anomaly_score") >= settings.anomaly_threshold).withColumn(
        "alert_type", F.coalesce(F.col("attack_type"), F.lit("anomaly"))
    )


def _stretches(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of one (address, type, slice) in sorted rows begin and end."""
    keys = rows[_SLICE]
    begin = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
    return begin, np.append(begin[1:], len(rows))


def _last_fires(at: np.ndarray, pause: int) -> np.ndarray:
    """The time of the last alert of a stretch if its first one is fired by each of its candidates."""
    following = np.searchsorted(at, at + pause)
    here = np.arange(len(at))
    last = np.where(following < len(at), following, here)
    while True:  # doubles the distance each round
        further = last[last]
        if np.array_equal(further, last):
            return at[last]
        last = further


class _StepMap:
    """From the moment from which alerts may fire at the begin of a slice to that at its end.

    A state up to ``upto[k]``, and above ``upto[k - 1]``, leads to ``leaves[k]``; a state above all
    of them stays as it is."""

    def __init__(self, key: tuple, first: int, pause: int) -> None:
        self.key, self.pause = key, pause
        self.reach = first + pause  # no earlier alert keeps the slice silent for longer
        self.upto, self.leaves = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def then(self, at: np.ndarray) -> None:
        """Composes the map with that of the next stretch, whose candidates are at these times."""
        at = np.unique(at)
        leaves = _last_fires(at, self.pause) + self.pause
        place = np.searchsorted(at, self.leaves)
        inside = place < len(at)
        self.leaves[inside] = leaves[place[inside]]
        if not len(self.upto) or self.upto[-1] < self.reach:
            begin = np.searchsorted(at, self.upto[-1], side="right") if len(self.upto) else 0
            end = np.searchsorted(at, self.reach) + 1
            self.upto = np.concatenate([self.upto, at[begin:end]])
            self.leaves = np.concatenate([self.leaves, leaves[begin:end]])

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        # Of neighbouring entry states with the same outcome, the last one is enough.
        kept = np.append(self.leaves[1:] != self.leaves[:-1], True)
        return self.upto[kept], self.leaves[kept]


def _table(maps: list[_StepMap]) -> pd.DataFrame:
    """The steps of all these maps; a frame per map would take longer than the maps themselves."""
    upto, leaves = zip(*(step_map.steps() for step_map in maps))
    repeats = [len(steps) for steps in upto]
    keys = {
        name: np.repeat(np.array(values, dtype=np.int64 if name == "_slice" else object), repeats)
        for name, values in zip(_SLICE, zip(*(step_map.key for step_map in maps)))
    }
    return pd.DataFrame({**keys, "upto": np.concatenate(upto), "leaves": np.concatenate(leaves)})


def _slice_steps(pause: int):
    """The step map of each slice, composed batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_map = None
        for rows in batches:
            if rows.empty:
                continue
            at, done = rows["_us"].to_numpy(), []
            begin, end = _stretches(rows)
            keys = zip(*(rows[name].to_numpy()[begin] for name in _SLICE))
            for key, first, stop in zip(keys, begin, end):
                if open_map is None or open_map.key != key:
                    if open_map is not None:
                        done.append(open_map)
                    open_map = _StepMap(key, int(at[first]), pause)
                open_map.then(at[first:stop])
            if done:
                yield _table(done)
        if open_map is not None:
            yield _table([open_map])

    return run


def _entry_states():
    """First moment of each slice at which an alert may fire, from steps in time order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, current, free_at, leaves_at, settled = None, None, _ALWAYS, _ALWAYS, False
        for rows in batches:
            if rows.empty:
                continue
            names = rows[_SLICE]
            starts = np.flatnonzero((names != names.shift()).any(axis=1).to_numpy())
            upto, leaves = rows["upto"].to_numpy(), rows["leaves"].to_numpy()
            out = []
            for begin, end in zip(starts, np.append(starts[1:], len(rows))):
                ip, kind, start = names.iloc[begin]
                if (ip, kind) != key:
                    key, current, leaves_at = (ip, kind), None, _ALWAYS
                if start != current:
                    current, free_at, settled = start, leaves_at, False
                    out.append((ip, kind, start, free_at))
                if not settled:  # a slice's steps may continue in the next batch
                    step = begin + np.searchsorted(upto[begin:end], free_at)
                    if step < end:
                        leaves_at, settled = int(leaves[step]), True
            yield pd.DataFrame(out, columns=[*_SLICE, "_free_at"])

    return run


def _fire(pause: int, width: int):
    """The candidates that fire; the state of a slice is carried to its next batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried_key, carried = None, _ALWAYS
        for rows in batches:
            if rows.empty:
                continue
            begin, end = _stretches(rows)
            free_at = rows["_free_at"].to_numpy()[begin].copy()
            if tuple(rows[_SLICE].iloc[0]) == carried_key:
                free_at[0] = carried
            # One axis on which slices follow each other, further apart than a pause.
            at, start = rows["_us"].to_numpy(), rows["_slice"].to_numpy()[begin]
            number = np.arange(len(begin))
            axis = np.repeat(number, end - begin) * width + at - np.repeat(start, end - begin)
            front = np.searchsorted(axis, number * width + np.clip(free_at - start, 0, width))
            limit, fired = end, []
            while True:
                inside = front < limit
                front, limit = front[inside], limit[inside]
                if not len(front):
                    break
                fired.append(front)
                front = np.searchsorted(axis, axis[front] + pause)
            places = np.sort(np.concatenate(fired)) if fired else np.zeros(0, np.int64)
            carried_key, carried = tuple(rows[_SLICE].iloc[-1]), free_at[-1]
            if len(places) and places[-1] >= begin[-1]:
                carried = at[places[-1]] + pause
            yield rows.iloc[places][["id", *_SLICE, "_us"]]

    return run


def cooldown(
    candidates: DataFrame,
    last_fires: DataFrame | None = None,
    ts: str = "ts",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """(id, source_ip, alert_type) of the candidates that fire, earliest ``(ts, id)`` first.

    ``last_fires`` is (source_ip, alert_type, last_fire) from earlier batches.
    """
    pause = settings.cooldown_seconds * MICROS
    seconds = max(settings.cooldown_slice_seconds, settings.cooldown_seconds)
    width = seconds * MICROS + 2 * pause  # keeps neighbouring groups more than a pause apart
    id_type = candidates.schema["id"].dataType.simpleString()
    step_type = "source_ip string, alert_type string, _slice bigint"
    micros = epoch_micros(F.col(ts))
    timed = candidates.select("id", *_KEY, micros.alias("_us"))
    if last_fires is not None:
        seeds = last_fires.select(*_KEY, epoch_micros(F.col("last_fire")).alias("_seed"))
        timed = timed.join(seeds, _KEY, "left").where(
            F.col("_seed").isNull() | (F.col("_us") >= F.col("_seed") + pause)
        )
    events = timed.select(
        "id", *_KEY, "_us", time_slice(F.col("_us"), seconds).alias("_slice")
    ).repartition(*_SLICE)
    in_order = events.sortWithinPartitions(*_SLICE, "_us", "id")
    steps = in_order.mapInPandas(
        _slice_steps(pause), f"{step_type}, upto bigint, leaves bigint"
    )
    entries = (
        steps.repartition(*_KEY)
        .sortWithinPartitions(*_SLICE, "upto")
        .mapInPandas(_entry_states(), f"{step_type}, _free_at bigint")
    )
    return (
        events.join(entries, _SLICE)
        .select("id", *_SLICE, "_us", "_free_at")
        .repartition(*_SLICE)  # a join need not keep groups whole
        .sortWithinPartitions(*_SLICE, "_us", "id")
        .mapInPandas(_fire(pause, width), f"id {id_type}, {step_type}, _us bigint")
        .select("id", *_KEY)
    )


def alert_message(
    severity: Column,
    alert_type: Column,
    source_ip: Column,
    score: Column,
    path: Column,
    status: Column,
) -> Column:
    """One-line text about an alert."""
    none = F.lit("None")
    return F.format_string(
        "[%s] %s detected from %s | score=%s path=%s status=%s",
        F.upper(severity),
        alert_type,
        source_ip,
        three_decimals(score),
        F.coalesce(path, none),
        F.coalesce(status.cast("string"), none),
    )


def alert_rows(fired: DataFrame, created_at: str = "ts") -> DataFrame:
    """Alert records, with default resolution state, for the events that fire."""
    severity = alert_severity(F.col("anomaly_score"))
    return fired.select(
        F.sha2(F.concat_ws(":", F.col("id").cast("string"), "alert_type"), 256).alias("id"),
        F.col("id").alias("event_id"),
        severity.alias("severity"),
        "alert_type",
        alert_message(
            severity,
            F.col("alert_type"),
            F.col("source_ip"),
            F.col("anomaly_score"),
            F.col("path"),
            F.col("status_code"),
        ).alias("message"),
        F.lit(False).alias("resolved"),
        F.lit(None).cast("string").alias("resolved_by"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        F.lit(False).alias("is_false_positive"),
        F.col(created_at).alias("created_at"),
    )


def fired_events(
    scored: DataFrame,
    last_fires: DataFrame | None = None,
    ts: str = "ts",
    created_at: str = "ts",
    settings: Settings = DEFAULTS,
    in_storage: bool = False,
) -> DataFrame:
    """Events that raise an alert. Candidates are read three times, so they are stored first
    unless ``scored`` is a table already."""
    keep = ["id", ts, "source_ip", "path", "status_code", "anomaly_score", "alert_type"]
    candidates = alert_candidates(scored, settings).select(*dict.fromkeys([*keep, created_at]))
    if not in_storage:
        candidates = stored(candidates, "alert-candidates")
    fired = cooldown(candidates, last_fires, ts, settings).select("id")
    return candidates.join(fired, "id", "left_semi")


def fire_alerts(
    scored: DataFrame,
    last_fires: DataFrame | None = None,
    ts: str = "ts",
    created_at: str = "ts",
    settings: Settings = DEFAULTS,
    in_storage: bool = False,
) -> DataFrame:
    return alert_rows(
        fired_events(scored, last_fires, ts, created_at, settings, in_storage), created_at
    )


def latest_fires(
    fired: DataFrame, last_fires: DataFrame | None = None, ts: str = "ts"
) -> DataFrame:
    """Cooldown state after a batch: latest alert time per (address, type)."""
    recent = fired.select(*_KEY, F.col(ts).alias("last_fire"))
    if last_fires is not None:
        recent = recent.unionByName(last_fires.select(*_KEY, "last_fire"))
    return recent.groupBy(*_KEY).agg(F.max("last_fire").alias("last_fire"))
