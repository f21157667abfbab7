import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade.operators.busy import _flagged, busy_addresses, busy_counts
from palisade.operators.features import event_defaults, sliding_counts, with_features
from palisade.operators.scoring import hybrid
from palisade.schemas import FEATURE_NAMES
from palisade.streaming import features as streaming
from palisade.streaming.features import COUNTS, features_stream
from samples import LOG_FIELDS, START, expected_counts, random_log

NAMES = [name for name, _ in COUNTS]


def as_dict(frame):
    return {
        row["id"]: {name: pytest.approx(row[name]) for name in NAMES} for row in frame.collect()
    }


@pytest.mark.parametrize("seed, slice_seconds", [(1, 300), (2, 900), (3, 86_400)])
def test_counts_match_a_direct_count(spark, seed, slice_seconds):
    log = random_log(seed)
    found = as_dict(
        sliding_counts(spark.createDataFrame(log, LOG_FIELDS), slice_seconds=slice_seconds)
    )
    assert found == expected_counts(log)


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_in_single_seconds_match_a_direct_count(spark, seed):
    log = random_log(seed, seconds=700)
    assert as_dict(busy_counts(spark.createDataFrame(log, LOG_FIELDS))) == expected_counts(log)


def test_busy_addresses_are_split_further(spark):
    log = random_log(4)
    frame = spark.createDataFrame(log, LOG_FIELDS)
    busy = {row[0] for row in busy_addresses(frame, "ts", 900, 60).collect()}
    assert busy == {"10.0.0.1"}
    result = sliding_counts(frame, busy_rows=60)
    assert as_dict(result) == expected_counts(log)
    assert result.columns == sliding_counts(frame).columns


@pytest.mark.parametrize("seed, seconds", [(5, 700), (6, 6_000)])
def test_busy_addresses_keep_their_resets(spark, seed, seconds):
    """Resets within a second, at an event, and of an address without events; several blocks."""
    log = random_log(seed, seconds=seconds)
    moments = sorted({row[1] for row in log if row[2] == "10.0.0.1"})
    resets = spark.createDataFrame(
        [("10.0.0.1", moments[len(moments) // 3]), ("10.0.0.1", moments[len(moments) // 2]),
         ("10.0.0.1", moments[len(moments) // 2] + dt.timedelta(microseconds=1)),
         ("10.0.0.2", START + dt.timedelta(seconds=seconds // 2)), ("10.9.9.9", START)],
        "source_ip string, reset_at timestamp_ntz",
    )
    frame = spark.createDataFrame(log, LOG_FIELDS)
    want = as_dict(sliding_counts(frame, resets=resets, busy_rows=None))
    assert as_dict(busy_counts(frame, resets=resets)) == want
    assert as_dict(sliding_counts(frame, resets=resets, busy_rows=60)) == want
    assert want != expected_counts(log)


def test_one_address_with_nearly_all_rows(spark):
    """No task takes much more than the others, though nine rows in ten have one address."""
    rows = [
        (nth, START + dt.timedelta(milliseconds=137 * nth), "10.0.0.1" if nth % 10 else f"10.0.1.{nth % 50}",
         "GET", f"/{nth % 7}", 200 if nth % 3 else 404, 0.0)
        for nth in range(4_000)
    ]
    frame = spark.createDataFrame(rows, LOG_FIELDS)
    split = _flagged(frame.where("source_ip = '10.0.0.1'"), "ts", None)
    per_task = [r["count"] for r in split.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) == 1 or max(per_task) <= 2 * sorted(per_task)[len(per_task) // 2]
    per_key = split.groupBy("source_ip", "_era", "_second").count().agg(F.max("count")).first()[0]
    assert per_key <= 8
    want = as_dict(sliding_counts(frame, busy_rows=None))
    assert as_dict(sliding_counts(frame, busy_rows=50)) == want


def test_frames_are_closed_at_both_ends(spark):
    times = [0, 5, 60, 300, 300.000001]
    log = [
        (nth, START + dt.timedelta(seconds=second), "1.1.1.1", "GET", "/a", 200, 0.0)
        for nth, second in enumerate(times)
    ]
    found = as_dict(sliding_counts(spark.createDataFrame(log, LOG_FIELDS)))
    assert found == expected_counts(log)
    assert found[3]["ip_req_count_5m"] == 4 and found[4]["ip_req_count_5m"] == 4


def test_slices_shorter_than_a_frame_are_refused(spark):
    with pytest.raises(ValueError):
        sliding_counts(spark.createDataFrame([], LOG_FIELDS), slice_seconds=299)


def test_flags_and_vector(spark):
    log = [(1, START, "1.1.1.1", "post", "/api/auth/login", 401, 0.0)]
    row = with_features(spark.createDataFrame(log, LOG_FIELDS)).first()
    assert [row[name] for name in FEATURE_NAMES[6:11]] == [1.0, 1.0, 1.0, 0.0, 0.0]
    assert row["features"] == pytest.approx([1, 1, 1, 1, 1, 401, 1, 1, 1, 0, 0, 0.2])
    assert len(row["features"]) == 12


def test_defaults(spark):
    log = [(1, START, "1.1.1.1", "post", "/", None, 0.0)]
    row = event_defaults(spark.createDataFrame(log, LOG_FIELDS)).first()
    assert (row["status_code"], row["method"]) == (0, "POST")


def test_resets_cut_the_frames(spark):
    log = [
        (nth, START + dt.timedelta(seconds=10 * nth), "1.1.1.1", "GET", f"/{nth}", 500, 0.0)
        for nth in range(6)
    ]
    resets = spark.createDataFrame(
        [("1.1.1.1", START + dt.timedelta(seconds=20)), ("2.2.2.2", START)],
        "source_ip string, reset_at timestamp_ntz",
    )
    found = as_dict(sliding_counts(spark.createDataFrame(log, LOG_FIELDS), resets=resets))
    assert [found[nth]["ip_req_count_1m"] for nth in range(6)] == [1, 2, 3, 1, 2, 3]
    assert [found[nth]["unique_paths_1m"] for nth in range(6)] == [1, 2, 3, 1, 2, 3]


def stream_counts(spark, tmp_path, log, parts, extra=None):
    """Feature rows of a stream that gets the log in ``parts`` files, oldest rows first."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    log = sorted(log, key=lambda row: (row[1], row[0]))
    size = -(-len(log) // parts)
    fields = LOG_FIELDS + (", reset boolean" if extra is not None else "")
    rows = [(*row, False) for row in log] if extra is not None else log
    frames = [rows[at : at + size] for at in range(0, len(rows), size)]
    if extra is not None:
        frames[1:1] = [extra]
    for rows_of_file in frames:
        spark.createDataFrame(rows_of_file, fields).coalesce(1).write.mode("append").parquet(source)
    stream = (
        spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(source)
        .withColumn("ingest_ts", F.localtimestamp())
    )
    running = (
        features_stream(stream).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True).start()
    )
    assert running.awaitTermination(300)
    return spark.read.parquet(target)


def test_stream_equals_batch(spark, tmp_path):
    log = random_log(5, rows=300)
    result = stream_counts(spark, tmp_path, log, parts=4)
    assert as_dict(result) == expected_counts(log)
    assert not result.where("late").count()


class HeldState:
    """What a task keeps of one address between micro-batches."""

    hasTimedOut, exists = False, False

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutTimestamp(self, at):
        pass


def test_a_busy_address_goes_through_a_task_in_parts(monkeypatch):
    """Counts of an address are those of all its rows, whatever is counted and given out at once."""
    draw = np.random.default_rng(5)
    total = 3000
    log = pd.DataFrame({
        "id": draw.integers(0, 2500, total), "source_ip": "a",
        "ts": pd.Timestamp(START) + pd.to_timedelta(draw.integers(0, 3000, total), "s"),
        "path": [f"/p{n}" if n else None for n in draw.integers(0, 9, total)],
        "status_code": draw.choice([200.0, 404.0, np.nan], total), "_arrival_ms": 5, "reset": False,
    })
    log.loc[draw.integers(0, total, 4), "reset"] = True
    log = log.sort_values("ts", kind="stable", ignore_index=True)
    columns = ["id", "source_ip", "ts", "path", "status_code"]
    # An address that is done within one part, in two micro-batches.
    parts = [log.iloc[:2000], log.iloc[2000:]]

    def run():
        state, found = HeldState(), []
        for part in parts:
            frames = [part.iloc[n : n + 90] for n in range(0, len(part), 90)]
            found += streaming._advance(columns, "ts", 300)(("a",), iter(frames), state)
        return found, state.get

    whole, kept = run()
    monkeypatch.setattr(streaming, "COUNTED", 70)
    monkeypatch.setattr(streaming, "GIVEN", 50)
    split, kept_of_split = run()
    assert len(split) > 50 and max(map(len, split)) == 50
    pd.testing.assert_frame_equal(
        pd.concat(split, ignore_index=True), pd.concat(whole, ignore_index=True))
    assert kept == kept_of_split
    # A plain count beside it.
    found = pd.concat(whole, ignore_index=True)
    assert len(found) == (~log["reset"]).sum()
    resets, rows = log.loc[log["reset"], "ts"], log[~log["reset"]]
    for row in found.iloc[::37].itertuples():
        inside = rows[(rows["ts"] <= row.ts) & (rows["ts"] >= row.ts - pd.Timedelta(60, "s"))]
        for reset in resets[resets < row.ts]:
            inside = inside[inside["ts"] > reset]
        assert row.ip_req_count_1m == len(inside)
        assert row.unique_paths_1m == inside["path"].nunique(dropna=False)
        assert row.ip_fail_count_1m == (inside["status_code"] >= 400).sum()


def test_stream_reset_forgets_an_address(spark, tmp_path):
    log = [
        (nth, START + dt.timedelta(seconds=nth), "1.1.1.1", "GET", "/a", 200, 0.0)
        for nth in range(6)
    ]
    reset = [(-1, START + dt.timedelta(seconds=2), "1.1.1.1", "GET", "/", 200, 0.0, True)]
    found = as_dict(stream_counts(spark, tmp_path, log, parts=2, extra=reset))
    assert [found[nth]["ip_req_count_1m"] for nth in range(6)] == [1, 2, 3, 1, 2, 3]


def test_state_of_a_silent_address_is_released(spark, tmp_path):
    """Arrival times are given, so that 1.1.1.1 is idle for longer than state is held."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    arrivals = [("1.1.1.1", 0), ("2.2.2.2", 3000), ("2.2.2.2", 3001), ("1.1.1.1", 3002)]
    for nth, (ip, arrival) in enumerate(arrivals):
        row = (nth, START, ip, "GET", "/a", 200, 0.0, START + dt.timedelta(seconds=arrival))
        spark.createDataFrame([row], LOG_FIELDS + ", ingest_ts timestamp_ntz").coalesce(
            1
        ).write.mode("append").parquet(source)
    stream = (
        spark.readStream.schema(LOG_FIELDS + ", ingest_ts timestamp_ntz")
        .option("maxFilesPerTrigger", 1).parquet(source)
    )
    running = (
        features_stream(stream).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    assert running.awaitTermination(300)
    found = {row["id"]: row["ip_req_count_1m"] for row in spark.read.parquet(target).collect()}
    assert found == {0: 1, 1: 1, 2: 2, 3: 1}


def test_features_feed_the_rules(spark):
    log = [
        (nth, START + dt.timedelta(seconds=nth), "1.1.1.1", "POST", "/login", 401, 0.2)
        for nth in range(12)
    ]
    scored = hybrid(with_features(spark.createDataFrame(log, LOG_FIELDS)), F.col("ml_score"))
    kinds = {row["id"]: row["attack_type"] for row in scored.collect()}
    assert [kinds[nth] for nth in (8, 9, 11)] == [None, "brute_force", "brute_force"]
