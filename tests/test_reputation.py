import datetime as dt
import random

import pytest

from palisade.config import Settings
from palisade.operators import reputation as ops
from samples import START, expected_reputation

FIELDS = "id bigint, ts timestamp_ntz, source_ip string, anomaly_score double"


def events(seed, rows=500):
    draw = random.Random(seed)
    return [
        (
            nth,
            START + dt.timedelta(seconds=draw.randrange(9000)),
            draw.choice(["1.1.1.1"] * 4 + ["2.2.2.2", f"3.3.3.{draw.randrange(9)}"]),
            draw.choice([0.0, 0.3, 0.7, 0.95, draw.random()]),
        )
        for nth in range(rows)
    ]


@pytest.mark.parametrize("fold", [(1, 60, 3600), (60,), (3600,), (10**6,), (7, 70, 7000)])
def test_matches_one_by_one(spark, fold):
    rows = events(1)
    options = Settings(fold_seconds=fold)
    table = ops.reputation(spark.createDataFrame(rows, FIELDS), settings=options).collect()
    assert {row["ip"]: row["reputation_score"] for row in table} == pytest.approx(
        expected_reputation(rows)
    )
    for row in table:
        own = [event for event in rows if event[2] == row["ip"]]
        assert row["total_events"] == len(own)
        assert row["total_alerts"] == sum(event[3] >= 0.7 for event in own)
        assert row["anomaly_sum"] == pytest.approx(sum(event[3] for event in own))
        assert row["first_seen"] == min(event[1] for event in own)
        assert row["last_seen"] == max(event[1] for event in own)


def test_one_address_with_all_events(spark):
    """The widest group that is ordered in a task is a second's events or sixty stretches."""
    rows = [
        (nth, START + dt.timedelta(milliseconds=37 * nth), "1.1.1.1", (nth % 11) / 10)
        for nth in range(20_000)
    ]
    found = ops.reputation(spark.createDataFrame(rows, FIELDS)).first()
    assert found["reputation_score"] == pytest.approx(expected_reputation(rows)["1.1.1.1"])
    assert found["total_events"] == 20_000


@pytest.mark.parametrize("cut", [1, 130, 499])
def test_merge_anywhere_equals_one_pass(spark, cut):
    rows = sorted(events(2), key=lambda row: (row[1], row[0]))
    known = ops.reputation(spark.createDataFrame(rows[:cut], FIELDS))
    later = ops.summarise_events(spark.createDataFrame(rows[cut:], FIELDS))
    merged = {row["ip"]: row for row in ops.merge_reputation(known, later).collect()}
    whole = {
        row["ip"]: row for row in ops.reputation(spark.createDataFrame(rows, FIELDS)).collect()
    }
    assert merged.keys() == whole.keys()
    for ip, row in whole.items():
        for name in ("total_events", "total_alerts", "tag", "first_seen", "last_seen"):
            assert merged[ip][name] == row[name]
        assert merged[ip]["reputation_score"] == pytest.approx(row["reputation_score"])


def test_overrides_hold_until_the_next_event(spark):
    rows = [(1, START, "1.1.1.1", 0.9), (2, START, "2.2.2.2", 0.0), (3, START, "3.3.3.3", 0.6)]
    table = ops.reputation(spark.createDataFrame(rows, FIELDS))
    assert {row["ip"]: row["tag"] for row in table.collect()} == {
        "1.1.1.1": "blocked", "2.2.2.2": "trusted", "3.3.3.3": "suspicious",
    }
    hour = dt.timedelta(hours=1)
    overrides = spark.createDataFrame(
        [
            ("1.1.1.1", "suspicious", START), ("1.1.1.1", "trusted", START + hour),
            ("2.2.2.2", "blocked", START - hour), ("9.9.9.9", "blocked", START),
        ],
        "ip string, tag string, override_ts timestamp_ntz",
    )
    assert {row["ip"]: row["tag"] for row in ops.override_tags(table, overrides).collect()} == {
        "1.1.1.1": "trusted", "2.2.2.2": "trusted", "3.3.3.3": "suspicious",
    }
    assert [row["ip"] for row in ops.unknown_overrides(table, overrides).collect()] == ["9.9.9.9"]
    assert ops.reputation_lookup(table, "2.2.2.2").count() == 1


def test_known_rows_without_events_keep_their_tag(spark):
    known = ops.reputation(spark.createDataFrame([(1, START, "1.1.1.1", 0.9)], FIELDS))
    pinned = ops.override_tags(
        known,
        spark.createDataFrame(
            [("1.1.1.1", "unknown", START)], "ip string, tag string, override_ts timestamp_ntz"
        ),
    )
    other = ops.summarise_events(spark.createDataFrame([(2, START, "2.2.2.2", 0.1)], FIELDS))
    merged = {row["ip"]: row["tag"] for row in ops.merge_reputation(pinned, other).collect()}
    assert merged == {"1.1.1.1": "unknown", "2.2.2.2": "trusted"}
