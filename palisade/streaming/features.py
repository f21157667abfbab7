"""The sliding-window features on a stream, one output row per event.

State per address: its events of the last five minutes, plus an allowance for events that arrive
out of order. Frames use event time. The watermark runs on arrival time, so no event is ever
dropped for being late, and state of an address that stays silent is released.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palisade.functions.time import MICROS
from palisade.operators.features import (
    BURST,
    FIVE_MINUTES,
    MINUTE,
    binary_flags,
    feature_vector,
)

# Fixed value: idle time, in seconds, after which the state of an address is released. It is
# longer than any frame, so releasing it cannot change a result.
IDLE_SECONDS = 960

ALLOWED_LATENESS = 300

# Times, status codes and path numbers as packed arrays; a busy address holds many events.
STATE_SCHEMA = "us binary, status binary, path binary, names array<string>"
#: Rows of an address that are counted, and given out, at once.
COUNTED, GIVEN = 200_000, 20_000
COUNTS = [
    ("ip_req_count_1m", T.LongType()),
    ("ip_req_count_5m", T.LongType()),
    ("ip_fail_count_1m", T.LongType()),
    ("ip_fail_count_5m", T.LongType()),
    ("unique_paths_1m", T.LongType()),
    ("avg_status_code_1m", T.DoubleType()),
    ("burst_rate", T.DoubleType()),
]


def _as_micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


def _unpacked(held: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    us, status, path, names = held
    paths = np.array(names, dtype=object)[np.frombuffer(path, np.int32)]
    return np.frombuffer(us, np.int64), np.frombuffer(status, np.int32).astype(np.int64), paths


def _packed(us: np.ndarray, status: np.ndarray, path: np.ndarray) -> tuple:
    codes, names = pd.factorize(path)
    return (
        us.tobytes(), status.astype(np.int32).tobytes(), codes.astype(np.int32).tobytes(),
        list(names),
    )


def _window_counts(us: np.ndarray, status: np.ndarray, path: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each of one address's events, sorted by time."""
    upto = np.searchsorted(us, us, side="right")
    since = {w: np.searchsorted(us, us - w * MICROS) for w in (BURST, MINUTE, FIVE_MINUTES)}
    failures = np.append(0, np.cumsum(status >= 400))
    statuses = np.append(0, np.cumsum(status))
    codes = pd.factorize(path)[0]
    by_path = np.lexsort((us, codes))
    gap = np.diff(us[by_path])
    same = np.diff(codes[by_path]) == 0
    replaces, lapses = np.zeros(len(us), bool), np.ones(len(us), bool)
    near = same & (gap <= MINUTE * MICROS)
    replaces[by_path[1:]] = near
    lapses[by_path[:-1]] = ~near
    replaced = np.append(0, np.cumsum(replaces))
    lapsed = np.append(0, np.cumsum(lapses))
    count_1m = upto - since[MINUTE]
    return {
        "ip_req_count_1m": count_1m,
        "ip_req_count_5m": upto - since[FIVE_MINUTES],
        "ip_fail_count_1m": failures[upto] - failures[since[MINUTE]],
        "ip_fail_count_5m": failures[upto] - failures[since[FIVE_MINUTES]],
        "unique_paths_1m": upto - replaced[upto] - lapsed[since[MINUTE]],
        "avg_status_code_1m": (statuses[upto] - statuses[since[MINUTE]]) / count_1m,
        "burst_rate": (upto - since[BURST]) / float(BURST),
    }


def _held(frames: Iterable[pd.DataFrame]) -> pa.Table:
    """One address's rows of a micro-batch, as Arrow columns. Texts that recur are kept once a frame:
    a row takes some 100 bytes so, a tenth of what it takes in pandas."""
    tables, recurring = [], None
    for frame in frames:
        table = pa.Table.from_pandas(frame, preserve_index=False, nthreads=1)
        if recurring is None:
            recurring = [
                name for name in table.column_names if pa.types.is_string(table.schema.field(name).type)
                and 2 * pc.count_distinct(table[name]).as_py() <= len(table)
            ]
        for name in recurring:
            texts = table[name].cast(pa.string()).dictionary_encode()
            table = table.set_column(table.column_names.index(name), name, texts)
        tables.append(table)
    return pa.concat_tables(tables, promote_options="permissive").unify_dictionaries()


def _plain(rows: pa.Table) -> pd.DataFrame:
    """The rows in pandas, texts as texts."""
    for nth, field in enumerate(rows.schema):
        if pa.types.is_dictionary(field.type):
            rows = rows.set_column(nth, field.name, rows[nth].cast(field.type.value_type))
    return rows.to_pandas(use_threads=False)


def _coded(column: pa.ChunkedArray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the ``known`` names followed by those of the column, and the names by number."""
    values = column.to_pandas()
    if isinstance(values.dtype, pd.CategoricalDtype):
        codes, names = values.cat.codes.to_numpy(np.int32), values.cat.categories.to_numpy(object)
    else:
        codes, names = pd.factorize(values.to_numpy(object))
    before, all_names = pd.factorize(np.concatenate([known, names]))
    named = np.append(before[len(known):], -1)  # null is -1
    return np.concatenate([before[: len(known)], named[codes]]).astype(np.int32), all_names


def _copies(rows: pa.Table, resets: np.ndarray, ts: str) -> np.ndarray:
    """For each row, how many rows with its id come before it; resets don't count."""
    place = pc.sort_indices(rows, sort_keys=[("id", "ascending"), (ts, "ascending")])
    place = place.to_numpy().astype(np.int64)
    place = place[~resets[place]]
    ids = rows["id"].take(pa.array(place))
    first = np.ones(len(place), bool)
    if len(place):
        first[1:] = ~pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, len(place) - 1)), False).to_numpy()
    nth = np.arange(len(place))
    copies = np.zeros(len(rows), np.int64)
    copies[place] = nth - np.maximum.accumulate(np.where(first, nth, 0))
    return copies


def _spans(us: np.ndarray, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Cuts rows ``start`` to ``end``, sorted by time, between two times into parts of about ``COUNTED``
    rows; each with the row from which on events reach into its frames."""
    while start < end:
        last = min(start + COUNTED, end)
        stop = min(int(np.searchsorted(us, us[last - 1], side="right")), end)
        yield start, stop, int(np.searchsorted(us, us[start] - FIVE_MINUTES * MICROS))
        start = stop


def _advance(columns: list[str], ts: str, lateness: int):
    keep_for = (FIVE_MINUTES + lateness) * MICROS

    def run(
        key: tuple, frames: Iterable[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _held(frames)
        arrived = int(pc.max(rows["_arrival_ms"]).as_py())
        sequence = pc.sort_indices(rows, sort_keys=[(ts, "ascending"), ("id", "ascending")])
        sequence = sequence.to_numpy().astype(np.int64)
        resets = rows["reset"].to_numpy()[sequence].astype(bool)
        times = _as_micros(rows[ts].to_pandas())[sequence]
        reset_times = times[resets]
        sequence, times = sequence[~resets], times[~resets]
        known = _unpacked(state.get if state.exists else (b"", b"", b"", []))
        old = len(known[0])
        newest_known = known[0].max() if old else None
        taken = np.concatenate([np.arange(old), old + sequence])
        us = np.concatenate([known[0], times])
        order = np.argsort(us, kind="stable")
        us, taken = us[order], taken[order]
        codes = rows["status_code"].to_pandas().fillna(0).to_numpy(np.int64)
        status = np.concatenate([known[1], codes])[taken]
        path, names = _coded(rows["path"], known[2])
        path = path[taken]
        # Frames do not reach back over a reset, so each stretch between resets stands alone.
        cuts = np.searchsorted(us, reset_times, side="right")
        found = {
            name: np.zeros(len(us), np.int32 if kind == T.LongType() else np.float64)
            for name, kind in COUNTS
        }
        for low, high in zip([0, *cuts], [*cuts, len(us)]):
            for start, stop, reach in _spans(us, low, high):
                part = slice(max(reach, low), stop)
                for name, values in _window_counts(us[part], status[part], path[part]).items():
                    found[name][start:stop] = values[start - part.start :]
        place = np.empty(len(us), np.int64)  # where the rows ended up
        place[order] = np.arange(len(us))
        place = place[old:]
        del times, taken, order, codes
        copy = _copies(rows.select(["id", ts]), rows["reset"].to_numpy().astype(bool), ts)
        rows = rows.select(columns)
        for start in range(0, len(sequence), GIVEN):
            some = slice(start, start + GIVEN)
            out = _plain(rows.take(pa.array(sequence[some])))
            for name, kind in COUNTS:
                values = found[name][place[some]]
                out[name] = values.astype(np.int64) if kind == T.LongType() else values
            out["copy"] = copy[sequence[some]]
            out["late"] = (
                False if newest_known is None else us[place[some]] < newest_known - lateness * MICROS
            )
            yield out
        start = cuts[-1] if len(cuts) else 0
        if len(us):
            start = max(start, int(np.searchsorted(us, us[-1] - keep_for)))
        paths = np.append(names, None)[path[start:]]
        state.update(_packed(us[start:], status[start:], paths))
        state.setTimeoutTimestamp(arrived + IDLE_SECONDS * 1000)

    return run


def features_stream(
    log: DataFrame, ts: str = "ts", lateness: int = ALLOWED_LATENESS
) -> DataFrame:
    """Adds the twelve features, ``features``, ``copy`` and ``late`` to a stream of log rows.

    ``copy`` numbers rows with the same id within a micro-batch. ``late`` marks rows older than
    the newest known event of the address by more than ``lateness`` seconds; their counts miss
    events that are no longer held. A row with ``reset`` set to true, where the stream has that
    column, is a command to forget the address and gives no output.
    """
    if "reset" in log.columns:
        marked = log.withColumn("reset", F.coalesce("reset", F.lit(False)))
    else:
        marked = log.withColumn("reset", F.lit(False))
    columns = [name for name in marked.columns if name != "reset"]
    # Watermarks need a zoned timestamp.
    arrival = F.col("ingest_ts").cast("timestamp")
    arriving = marked.withColumns({"_arrival": arrival, "_arrival_ms": F.unix_millis(arrival)})
    fields = [marked.schema[name] for name in columns]
    counts = [T.StructField(name, kind) for name, kind in COUNTS]
    extra = [T.StructField("copy", T.LongType()), T.StructField("late", T.BooleanType())]
    counted = (
        arriving.withWatermark("_arrival", "1 minute")
        .groupBy("source_ip")
        .applyInPandasWithState(
            _advance(columns, ts, lateness),
            T.StructType([*fields, *counts, *extra]),
            STATE_SCHEMA,
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
    return feature_vector(binary_flags(counted))
