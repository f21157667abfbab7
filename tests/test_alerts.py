import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from palisade.config import Settings
from palisade.operators.alerts import _StepMap, alert_candidates, cooldown, fire_alerts, latest_fires
from samples import START, expected_fires

FIELDS = "id bigint, ts timestamp_ntz, source_ip string, alert_type string"
MINUTE_SLICES = Settings(cooldown_slice_seconds=60)


def fired(spark, rows, **options):
    frame = spark.createDataFrame(rows, FIELDS)
    return {row["id"] for row in cooldown(frame, **options).collect()}


def rows_at(seconds, ip="1.1.1.1", kind="anomaly", first=0):
    return [
        (first + nth, START + dt.timedelta(seconds=second), ip, kind)
        for nth, second in enumerate(seconds)
    ]


def test_exactly_one_pause_later_fires(spark):
    assert fired(spark, rows_at([0, 59.999999, 60, 119, 120])) == {0, 2, 4}


def test_silent_events_do_not_extend_the_pause(spark):
    assert fired(spark, rows_at(range(0, 200, 10))) == {0, 6, 12, 18}


def test_ties_fire_the_lowest_id(spark):
    rows = [(nth, START, "1.1.1.1", "anomaly") for nth in (5, 3, 9)]
    assert fired(spark, rows) == {3}


@pytest.mark.parametrize("cooldown_slice_seconds", [60, 600, 3600])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_one_by_one(spark, seed, cooldown_slice_seconds):
    draw = random.Random(seed)
    rows = [
        (
            nth,
            START + dt.timedelta(milliseconds=draw.randrange(4_000) * 1_000),
            draw.choice(["1.1.1.1"] * 5 + ["2.2.2.2", "3.3.3.3"]),
            draw.choice(["anomaly", "ddos_spike"]),
        )
        for nth in range(1500)
    ]
    options = Settings(cooldown_slice_seconds=cooldown_slice_seconds)
    assert fired(spark, rows, settings=options) == expected_fires(rows)


@pytest.mark.parametrize("batch_rows", [1, 3, 50])
@pytest.mark.parametrize("cooldown_slice_seconds", [60, 3600])
def test_slices_pass_through_in_batches(spark, batch_rows, cooldown_slice_seconds):
    draw = random.Random(batch_rows)
    one_key = rows_at(sorted(draw.randrange(0, 1600) for _ in range(400)))
    others = rows_at([draw.randrange(0, 1600) for _ in range(60)], ip="2.2.2.2", first=1000)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    try:
        options = Settings(cooldown_slice_seconds=cooldown_slice_seconds)
        assert fired(spark, one_key + others, settings=options) == expected_fires(one_key + others)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_composed_map_equals_that_of_the_whole():
    pause = 60
    for seed in range(30):
        draw = random.Random(seed)
        at = np.sort(np.array([draw.randrange(400) for _ in range(draw.randint(1, 80))]))
        cuts = sorted(draw.randrange(len(at) + 1) for _ in range(4))
        whole, parts = _StepMap(("k",), int(at[0]), pause), _StepMap(("k",), int(at[0]), pause)
        whole.then(at)
        for part in np.split(at, cuts):
            if len(part):
                parts.then(part)
        for state in range(int(at[0]) - 5, int(at[0]) + pause):
            free_at = state
            for moment in at:
                if moment >= free_at:
                    free_at = moment + pause
            for made in (whole, parts):
                place = np.searchsorted(made.upto, state)
                assert free_at == (made.leaves[place] if place < len(made.upto) else state)
        assert len(parts.upto) <= len(np.unique(at[at < at[0] + pause])) + 1


@settings(
    max_examples=8, deadline=None, derandomize=True,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(st.lists(st.integers(0, 900), min_size=1, max_size=60))
def test_any_times(spark, seconds):
    rows = rows_at(seconds)
    assert fired(spark, rows, settings=MINUTE_SLICES) == expected_fires(rows)


def test_earlier_batches_count(spark):
    first, second = rows_at([0, 30, 70]), rows_at([100, 129, 130, 131], first=10)
    whole = expected_fires(first + second)
    frame = spark.createDataFrame(first, FIELDS)
    early = fired(spark, first)
    state = latest_fires(frame.where(frame.id.isin(list(early))))
    late = fired(spark, second, last_fires=state)
    assert early | late == whole and late
    again = latest_fires(spark.createDataFrame(second, FIELDS).where("id = 12"), state).collect()
    assert [row["last_fire"] for row in again] == [START + dt.timedelta(seconds=130)]


def test_alert_rows(spark):
    scored = spark.createDataFrame(
        [
            (1, START, "1.1.1.1", "/x", None, 0.7, None),
            (2, START, "1.1.1.1", None, 401, 0.9500001, "brute_force"),
            (3, START, "1.1.1.1", "/y", 200, 0.6999, "anomaly"),
        ],
        "id bigint, ts timestamp_ntz, source_ip string, path string, status_code int, "
        "anomaly_score double, attack_type string",
    )
    assert {row["id"]: row["alert_type"] for row in alert_candidates(scored).collect()} == {
        1: "anomaly", 2: "brute_force",
    }
    alerts = {row["event_id"]: row for row in fire_alerts(scored).collect()}
    assert alerts[1]["message"] == (
        "[MEDIUM] anomaly detected from 1.1.1.1 | score=0.700 path=/x status=None"
    )
    assert alerts[2]["message"] == (
        "[CRITICAL] brute_force detected from 1.1.1.1 | score=0.950 path=None status=401"
    )
    assert alerts[2]["severity"] == "critical"
    assert (alerts[1]["resolved"], alerts[1]["is_false_positive"]) == (False, False)
    assert len({row["id"] for row in alerts.values()}) == 2
