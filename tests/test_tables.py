import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade.operators import dashboard, feedback, tables
from palisade.operators.parse import accepted, parse_log
from palisade.sources import capture
from samples import START

EVENTS = (
    "id bigint, ts timestamp_ntz, source_ip string, path string, anomaly_score double, "
    "attack_type string, label string, created_at timestamp_ntz"
)


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (
            nth, START + dt.timedelta(seconds=nth // 2), f"10.0.0.{nth % 3}", "/x",
            nth / 100 if nth % 5 else None, "anomaly" if nth > 70 else None, None,
            START + dt.timedelta(seconds=nth // 2),
        )
        for nth in range(100)
    ]
    return spark.createDataFrame(rows, EVENTS)


def ids(frame):
    return [row["id"] for row in frame.collect()]


def test_pages(events):
    assert ids(tables.list_events(events, limit=3)) == [98, 99, 96]
    assert ids(tables.list_events(events, skip=3, limit=2)) == [97, 94]
    assert ids(tables.list_events(events, limit=2, source_ip="10.0.0.1")) == [97, 94]
    assert ids(tables.list_events(events, min_score=0.98)) == [98, 99]
    assert len(ids(tables.list_events(events))) == 50
    assert len(ids(tables.list_events(events, limit=200, attack_type="anomaly"))) == 29
    assert ids(tables.get_event(events, 7)) == [7] and ids(tables.get_event(events, 777)) == []
    assert tables.event_count(events).first()["count"] == 100


@pytest.mark.parametrize("page", [{"skip": -1}, {"limit": 0}, {"limit": 201}])
def test_page_bounds(events, page):
    with pytest.raises(ValueError):
        tables.list_events(events, **page)
    with pytest.raises(ValueError):
        tables.list_alerts(events, **page)


def test_labels(spark, events):
    updates = spark.createDataFrame(
        [
            (1, "normal", START), (1, "attack", START + dt.timedelta(1)), (2, "spam", START),
            (3, "false_positive", START), (3, None, START + dt.timedelta(1)), (555, "normal", START),
        ],
        "event_id bigint, label string, labelled_at timestamp_ntz",
    )
    labelled = tables.label_events(events, updates)
    found = {row["id"]: row["label"] for row in labelled.where("label IS NOT NULL").collect()}
    assert found == {1: "attack", 3: "false_positive"}
    assert labelled.columns == events.columns
    unknown = tables.unknown_labels(events, updates.where(tables.valid_labels(updates)))
    assert [row["event_id"] for row in unknown.collect()] == [555]
    count = feedback.feedback_count(labelled, minimum=1).first()
    assert (count["feedback_events"], count["enough"]) == (1, True)
    assert not feedback.feedback_count(labelled).first()["enough"]
    assert ids(feedback.training_rows(labelled, limit=3)) == [0, 2, 4]


@pytest.mark.parametrize("name, values", [
    ("label", {"normal": True, "attack": True, "false_positive": True, "bad": False, None: False}),
    ("tag", {"trusted": True, "suspicious": True, "blocked": True, "unknown": True, "evil": False}),
])
def test_domains(spark, name, values):
    frame = spark.createDataFrame([(value,) for value in values], f"{name} string")
    check = tables.valid_labels if name == "label" else tables.valid_tags
    found = frame.select(name, check(frame).alias("ok")).collect()
    assert {row[0]: row[1] for row in found} == values


def test_resolutions(spark, events):
    alerts = spark.createDataFrame(
        [
            (key, number, "critical", "anomaly", "m", False, None, None, False, START)
            for key, number in [("a", 1), ("b", 2), ("c", 3), ("d", 4_000)]
        ],
        "id string, event_id bigint, severity string, alert_type string, message string, "
        "resolved boolean, resolved_by string, resolved_at timestamp_ntz, "
        "is_false_positive boolean, created_at timestamp_ntz",
    )
    resolutions = spark.createDataFrame(
        [("a", None, START, None), ("b", "kim", START, True), ("zz", "kim", START, True)],
        "alert_id string, resolved_by string, resolved_at timestamp_ntz, is_false_positive boolean",
    )
    resolved = tables.resolve_alerts(alerts, resolutions)
    rows = {row["id"]: row for row in resolved.collect()}
    assert (rows["a"]["resolved_by"], rows["a"]["is_false_positive"]) == ("analyst", False)
    assert (rows["b"]["resolved_by"], rows["b"]["is_false_positive"]) == ("kim", True)
    assert not rows["c"]["resolved"] and rows["c"]["resolved_by"] is None
    assert tables.alert_stats(resolved).first().asDict() == {
        "total_alerts": 4, "active_alerts": 2, "critical_active": 2,
    }
    assert ids(tables.list_alerts(resolved, resolved=False)) == ["c", "d"]
    assert ids(tables.list_alerts(resolved, severity="low")) == []
    labelled = tables.label_false_positives(events, resolved)
    assert ids(labelled.where("label = 'false_positive'")) == [2]
    assert {row["id"] for row in tables.event_alerts(events, alerts).collect()} == {"a", "b", "c"}
    assert ids(tables.orphan_alerts(events, alerts)) == ["d"]


def test_rolling_mean_and_totals(events):
    rows = sorted(
        dashboard.rolling_avg_score(events, rows=7).collect(), key=lambda row: row["id"]
    )
    scores = [0.0 if nth % 5 == 0 else nth / 100 for nth in range(100)]
    for nth, row in enumerate(rows):
        latest = scores[max(0, nth - 6) : nth + 1]
        assert row["rolling_avg_score"] == pytest.approx(sum(latest) / len(latest))
    totals = {row["id"]: row for row in dashboard.running_totals(events).collect()}
    assert [totals[nth]["events_so_far"] for nth in range(100)] == list(range(1, 101))
    assert totals[99]["alerts_so_far"] == sum(score >= 0.7 for score in scores)


def test_runs_of_the_rolling_mean_overlap(events, monkeypatch):
    monkeypatch.setattr(dashboard, "_RANKS_PER_TASK", 10)
    short = {row["id"]: row[2] for row in dashboard.rolling_avg_score(events, rows=7).collect()}
    monkeypatch.setattr(dashboard, "_RANKS_PER_TASK", 1000)
    whole = {row["id"]: row[2] for row in dashboard.rolling_avg_score(events, rows=7).collect()}
    assert short == pytest.approx(whole)


def test_all_events_in_one_second(spark, monkeypatch):
    rows = spark.range(40_000).select(
        "id", F.expr("timestamp_ntz '2024-01-01 00:00:00'").alias("ts"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 100) / 100).alias("anomaly_score"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = dashboard.in_ranges(rows).groupBy("_range").count().toPandas()["count"]
        assert len(sizes) == 4 and sizes.max() < 2 * sizes.median()
        totals = dashboard.running_totals(rows).orderBy("id").toPandas()
        monkeypatch.setattr(dashboard, "_RANKS_PER_TASK", 1000)
        means = dashboard.rolling_avg_score(rows).orderBy("id").toPandas()["rolling_avg_score"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    scores = pd.Series([nth % 100 / 100 if nth % 5 else 0.0 for nth in range(40_000)])
    assert (totals["events_so_far"] == totals["id"] + 1).all()
    assert (totals["alerts_so_far"] == (scores >= 0.7).cumsum()).all()
    assert (means - scores.rolling(500, min_periods=1).mean()).abs().max() < 1e-9


def test_ranks_of_no_events(events):
    assert dashboard.running_totals(events.where("false")).count() == 0
    assert dashboard.rolling_avg_score(events.where("false")).count() == 0


def test_live_view(events):
    table = dashboard.event_table(events, " 0.0.1 ", 0.9)
    assert ids(table) == [97, 94, 91]
    assert {row["score_band"] for row in table.collect()} == {"critical"}
    feed = dashboard.alert_feed(events).collect()
    assert len(feed) == 24 and feed[0]["id"] == 99 and feed[-1]["alert_type"] == "anomaly"
    ticks = dashboard.timeline(events, ticks=2).orderBy("tick").collect()
    assert [row["events"] for row in ticks] == [2, 2]


def test_payloads(spark, events):
    rows = events.where("id = 71").withColumns({"method": F.lit("GET"), "status_code": F.lit(200)})
    assert capture.live_feed(rows).first()["payload"] == (
        '{"event":{"id":"71","timestamp":"2024-01-01T00:10:35","source_ip":"10.0.0.2",'
        '"method":"GET","path":"/x","status_code":200,"anomaly_score":0.71,'
        '"attack_type":"anomaly"}}'
    )
    flat = capture.live_feed(rows, nested=False).first()["payload"]
    assert flat.startswith('{"event_id":"71"') and flat.endswith('"severity":"medium"}')


def test_capture(spark):
    requests = spark.createDataFrame(
        [
            (1, "9.9.9.9", " 1.1.1.1 , 2.2.2.2", "GET", "wp-login.php", "a=1", None),
            (2, "9.9.9.9", "", "POST", "x", "", "curl"),
            (3, None, None, "GET", "ADMIN", None, "curl"),
        ],
        "id int, peer_ip string, x_forwarded_for string, method string, path string, "
        "query string, user_agent string",
    )
    timed = requests.withColumn("captured_at", F.expr("timestamp_ntz '2024-05-06 07:08:09.5'"))
    rows = capture.capture_log(timed).orderBy("id").collect()
    assert {row["timestamp"] for row in rows} == {"2024-05-06T07:08:09.500000"}
    # A captured request that is published and parsed keeps its time and its text.
    published = capture.publish_log(capture.capture_log(timed).drop("id")).withColumn(
        "ingest_ts", F.expr("timestamp_ntz '2030-01-01'"))
    parsed = accepted(parse_log(published)).orderBy("user_agent", "method").collect()
    assert {row["ts"] for row in parsed} == {dt.datetime(2024, 5, 6, 7, 8, 9, 500000)}
    assert {row["raw_log"] for row in parsed} == {row["raw_log"] for row in rows}
    assert [row["source_ip"] for row in rows] == ["1.1.1.1", "9.9.9.9", "127.0.0.1"]
    assert [row["path"] for row in rows] == ["/wp-login.php?a=1", "/x", "/ADMIN"]
    assert [row["status_code"] for row in rows] == [200, 404, 404]
    assert [row["user_agent"] for row in rows] == ["", "curl", "curl"]
