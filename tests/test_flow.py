import datetime as dt
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palisade.operators.scoring import hybrid
from palisade.plans.jobs import process_log
from palisade.sources import tables
from palisade.sources.raw import raw_stream, raw_text, write_channel
from palisade.streaming.dashboard import events_per_second_stream, running_totals_stream
from palisade.streaming.features import features_stream
from palisade.streaming.flow import Flow, log_stream
from samples import LOG_FIELDS, START, random_log


def by_ml_score(featured, _=None):
    return hybrid(featured, F.col("ml_score"))


@pytest.fixture(scope="module")
def log():
    return sorted(random_log(11, rows=240, seconds=1200), key=lambda row: (row[1], row[0]))


@pytest.fixture(scope="module")
def flow(spark, log, tmp_path_factory):
    """The job after four micro-batches, with a stop and restart in between."""
    base = tmp_path_factory.mktemp("flow")
    source = str(base / "in")
    job = Flow(str(base / "out"), score=by_ml_score, compact_every=2)

    def run():
        stream = (
            spark.readStream.schema(LOG_FIELDS).option("maxFilesPerTrigger", 1).parquet(source)
            .withColumn("ingest_ts", F.localtimestamp())
        )
        running = job.start(stream, str(base / "checkpoint"), available_now=True)
        assert running.awaitTermination(300)

    for part in range(4):
        rows = log[part * 60 : part * 60 + 60]
        spark.createDataFrame(rows, LOG_FIELDS).coalesce(1).write.mode("append").parquet(source)
        if part in (1, 3):
            run()
    return job


@pytest.fixture(scope="module")
def whole(spark, log):
    return process_log(spark.createDataFrame(log, LOG_FIELDS), by_ml_score)


def rows_of(frame, *names):
    return {
        row[0]: tuple(
            pytest.approx(value) if isinstance(value, float) else value for value in row[1:]
        )
        for row in frame.select(*names).collect()
    }


def test_events_equal_the_batch_job(spark, flow, whole):
    names = ["id", "ts", "source_ip", "path", "ip_req_count_5m", "unique_paths_1m",
             "anomaly_score", "attack_type"]
    assert rows_of(flow.events(spark), *names) == rows_of(whole.events, *names)
    assert {len(row["features"]) for row in flow.events(spark).select("features").collect()} == {12}


def test_alerts_equal_the_batch_job(spark, flow, whole):
    names = ["id", "event_id", "severity", "alert_type", "message"]
    found = rows_of(flow.alerts(spark), *names)
    assert found == rows_of(whole.alerts, *names) and found


def test_reputation_equals_the_batch_job(spark, flow, whole):
    names = ["ip", "total_events", "total_alerts", "anomaly_sum", "reputation_score", "tag",
             "first_seen", "last_seen"]
    assert tables.latest_version(spark, flow.table("reputation")) is not None
    assert rows_of(flow.reputation(spark), *names) == rows_of(whole.reputation, *names)


def test_a_retried_batch_changes_nothing(spark, flow):
    before = rows_of(flow.alerts(spark), "id", "message")
    last = max(
        row[0] for row in flow.events(spark).select("batch_id").distinct().collect()
    )
    events = flow.events(spark).where(F.col("batch_id") == last)
    schema = events.drop("batch_id", "day").schema
    flow._store_alerts(tables.read_batch(spark, flow.table("events"), schema, last), last)
    assert rows_of(flow.alerts(spark), "id", "message") == before


def test_live_feed_has_every_event(spark, flow):
    payloads = spark.read.text(flow.table("live_feed")).select("value").collect()
    ids = {json.loads(row["value"])["event"]["id"] for row in payloads}
    assert ids == {str(nth) for nth in range(240)}


def test_messages_end_to_end(spark, tmp_path):
    channel = str(tmp_path / "channel")
    good = [
        {"timestamp": (START + dt.timedelta(seconds=nth)).isoformat(), "source_ip": "1.1.1.1",
         "method": "GET", "path": "/x", "status_code": 200} for nth in range(5)
    ]
    lines = [json.dumps(row) for row in [*good, good[0]]] + ["not json", "7", '{"path": null}']
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(channel)
    job = Flow(str(tmp_path / "out"))
    running = job.start(
        log_stream(raw_stream(spark, channel)), str(tmp_path / "c1"), available_now=True
    )
    assert running.awaitTermination(300)
    side = job.start_quarantine(raw_stream(spark, channel), str(tmp_path / "c2"), True)
    assert side.awaitTermination(300)
    events = job.events(spark).collect()
    assert len(events) == 6 and len({row["id"] for row in events}) == 6
    assert max(row["ip_req_count_1m"] for row in events) == 6
    assert {row["anomaly_score"] for row in events} == {0.5}  # no models yet
    rejected = spark.read.parquet(job.table("quarantine"))
    assert {row["reject_reason"] for row in rejected.collect()} == {
        "not JSON", "not an object", "null path",
    }


def test_published_records_can_be_read_back(spark, log, tmp_path):
    channel = str(tmp_path / "channel")
    write_channel(spark.createDataFrame(log[:5], LOG_FIELDS), channel)
    rows = raw_text(spark, channel).collect()
    assert {json.loads(row["value"])["id"] for row in rows} == {row[0] for row in log[:5]}
    assert all("status_code" in json.loads(row["value"]) for row in rows)


def test_late_rows_are_marked(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    minutes = {0: 30, 1: 27, 2: 20}  # the second is late but held, the third is too late
    for nth, minute in minutes.items():
        row = (nth, START + dt.timedelta(minutes=minute), "1.1.1.1", "GET", "/a", 200, 0.0)
        spark.createDataFrame([row], LOG_FIELDS).coalesce(1).write.mode("append").parquet(source)
    stream = (
        spark.readStream.schema(LOG_FIELDS).option("maxFilesPerTrigger", 1).parquet(source)
        .withColumn("ingest_ts", F.localtimestamp())
    )
    running = (
        features_stream(stream).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    assert running.awaitTermination(300)
    found = {row["id"]: row["late"] for row in spark.read.parquet(target).collect()}
    assert found == {0: False, 1: False, 2: True}


def test_late_rows_are_stored_whole(spark, tmp_path):
    source = str(tmp_path / "in")
    job = Flow(str(tmp_path / "out"), score=by_ml_score)
    for nth, minute in enumerate([30, 27, 20]):
        row = (nth, START + dt.timedelta(minutes=minute), "1.1.1.1", "GET", f"/{nth}", 200, 0.25)
        spark.createDataFrame([row], LOG_FIELDS).coalesce(1).write.mode("append").parquet(source)
    stream = (
        spark.readStream.schema(LOG_FIELDS).option("maxFilesPerTrigger", 1).parquet(source)
        .withColumn("ingest_ts", F.localtimestamp())
    )
    assert job.start(stream, str(tmp_path / "c"), available_now=True).awaitTermination(300)
    late = job.late(spark).collect()
    assert [(row["id"], row["path"], row["ml_score"]) for row in late] == [(2, "/2", 0.25)]
    assert late[0]["ts"] == START + dt.timedelta(minutes=20) and len(late[0]["features"]) == 12
    assert {row["id"] for row in job.events(spark).collect()} == {0, 1, 2}
    assert job.reputation(spark).first()["total_events"] == 3


def test_late_rows_count_what_came_before_them(spark, tmp_path):
    """Their frames are long gone from the stream's state."""
    source = str(tmp_path / "in")
    job = Flow(str(tmp_path / "out"), score=by_ml_score)
    first = [(nth, START + dt.timedelta(seconds=nth), "1.1.1.1", "GET", f"/{nth}", 404, 0.1)
             for nth in range(5)]
    other = (5, START, "2.2.2.2", "GET", "/", 200, 0.1)
    newest = (6, START + dt.timedelta(hours=2), "1.1.1.1", "GET", "/n", 200, 0.1)
    late = [(7, START + dt.timedelta(seconds=3), "1.1.1.1", "GET", "/0", 500, 0.9),
            (8, START + dt.timedelta(seconds=4), "1.1.1.1", "GET", "/x", 200, 0.1)]
    for rows in ([*first, other], [newest], late):
        spark.createDataFrame(rows, LOG_FIELDS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LOG_FIELDS).parquet(source).withColumn(
            "ingest_ts", F.localtimestamp())
        running = job.start(stream, str(tmp_path / "c"), available_now=True)
        assert running.awaitTermination(300)
    found = {row["id"]: row for row in job.events(spark).collect()}
    assert set(found) == set(range(9))
    assert (found[7]["ip_req_count_1m"], found[7]["unique_paths_1m"]) == (5, 4)
    assert (found[8]["ip_req_count_1m"], found[8]["ip_fail_count_1m"]) == (7, 6)
    assert found[8]["unique_paths_1m"] == 6 and len(found[8]["features"]) == 12
    assert {row["event_id"] for row in job.alerts(spark).collect()} == {7}
    ips = {row["ip"]: row["total_events"] for row in job.reputation(spark).collect()}
    assert ips == {"1.1.1.1": 8, "2.2.2.2": 1}


def test_analyst_updates_show_in_the_readers(spark, flow):
    at = START + dt.timedelta(days=1)
    alerts = flow.alerts(spark).orderBy("event_id").collect()
    wrong, right = alerts[0], alerts[1]
    free = [n for n in range(240) if n not in {row["event_id"] for row in alerts}][:3]
    labels = [(free[0], "attack", at), (free[0], "normal", at + dt.timedelta(hours=1)),
              (free[1], "spam", at), (9999, "normal", at),
              (right["event_id"], "attack", at)]
    flow.label(spark.createDataFrame(labels, "event_id bigint, label string, labelled_at timestamp_ntz"))
    resolutions = [(wrong["id"], "ann", at, True), (right["id"], None, at, None)]
    flow.resolve(spark.createDataFrame(
        resolutions,
        "alert_id string, resolved_by string, resolved_at timestamp_ntz, is_false_positive boolean"))
    fields = "ip string, tag string, override_ts timestamp_ntz"
    flow.override(spark.createDataFrame([("10.0.0.1", "trusted", at), ("10.0.0.2", "no", at)], fields))
    flow.override(spark.createDataFrame([("10.0.0.1", "suspicious", at + dt.timedelta(hours=1)),
                                         ("10.0.0.3", "blocked", START - dt.timedelta(days=1))], fields))
    found = {row["id"]: row["label"] for row in flow.events(spark).collect()}
    assert len(found) == 240
    assert {number: label for number, label in found.items() if label} == {
        free[0]: "normal", wrong["event_id"]: "false_positive", right["event_id"]: "attack",
    }
    after = {row["id"]: row for row in flow.alerts(spark).collect()}
    assert after[wrong["id"]]["resolved_by"] == "ann" and after[wrong["id"]]["is_false_positive"]
    assert after[right["id"]]["resolved_by"] == "analyst" and after[right["id"]]["resolved"]
    assert not after[right["id"]]["is_false_positive"]
    assert sum(row["resolved"] for row in after.values()) == 2
    tags = {row["ip"]: row["tag"] for row in flow.reputation(spark).collect()}
    plain = {row["ip"]: row["tag"] for row in flow._reputation(spark).collect()}
    assert tags == plain | {"10.0.0.1": "suspicious"}


def test_every_alert_is_in_the_outbox(spark, flow):
    sent = sorted(row["text"] for row in flow.outbox(spark).collect())
    assert sent and sent == sorted(row["message"] for row in flow.alerts(spark).collect())


def test_old_snapshots_go(spark, log, tmp_path):
    root = str(tmp_path / "s")
    for version in range(4):
        tables.write_snapshot(spark.createDataFrame(log[: version + 1], LOG_FIELDS), root, version)
    tables.prune_snapshots(spark, root, 2)
    assert tables.latest_version(spark, root) == 3
    assert tables.latest_version(spark, root, before=3) == 2
    assert tables.latest_version(spark, root, before=2) is None


def test_compacted_tables_read_the_same_from_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FAN_IN", 3)
    root, every, batches = str(tmp_path / "t"), 3, 31
    most = 0
    for number in range(batches):
        day = F.date_add(F.to_timestamp_ntz(F.lit("2024-01-01")), F.lit(number % 2))
        frame = spark.range(number * 7, number * 7 + 7, numPartitions=1).select(
            (F.col("id") * 37 % 1009).alias("id"), day.cast("timestamp_ntz").alias("ts"))
        if number != 5:  # a micro-batch without rows leaves no folder
            tables.write_batch(frame, root, number, date_of="ts")
        if number % every == 0:
            tables.compact(spark, root, number - 1, "id")
        folders = [*(tmp_path / "t").glob("batch_id=*"), *(tmp_path / "t_runs").glob("run=*")]
        most = max(most, len(folders))
    expected = sorted(
        (nth * 37 % 1009, nth // 7) for nth in range(batches * 7) if nth // 7 != 5)

    def rows(last=None):
        found = tables.read_complete(spark, root, last=last).select("id", "batch_id", "day", "ts")
        collected = found.collect()
        assert all(row["day"] == row["ts"].date() for row in collected)
        return sorted((row["id"], row["batch_id"]) for row in collected)

    assert rows() == expected
    assert rows(last=29) == [row for row in expected if row[1] <= 29]
    runs = tables.current_runs(spark, root)
    assert [run.first for run in runs[1:]] == [run.last + 1 for run in runs[:-1]]
    assert runs[0].first == 0 and runs[0].level == 2
    # Runs of three levels, those they replace until the next turn, and the batches of two turns.
    assert most <= 2 * tables.FAN_IN * 3 + 2 * every

    # The run that was written last may be incomplete; what it replaces is still there.
    (tmp_path / "t_runs" / runs[-1].path("").split("/")[-1] / "_SUCCESS").unlink()
    assert rows() == expected
    tables.compact(spark, root, 29, "id")
    assert rows() == expected
    # In order of ids, files of a day share none.
    for folder in (tmp_path / "t_runs").glob("run=2-*/day=*"):
        ranges = []
        for path in folder.glob("*.parquet"):
            group = pq.ParquetFile(path).metadata.row_group(0).column(0).statistics
            ranges.append((group.min, group.max))
        ranges.sort()
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_cooldown_writes_follow_the_batch(spark, log, tmp_path):
    job = Flow(str(tmp_path / "out"), score=by_ml_score)
    fire = F.expr("timestamp_ntz '2023-01-01 00:00:00'")
    many = spark.range(5000).select(
        F.concat(F.lit("a"), "id").alias("source_ip"), F.lit("anomaly").alias("alert_type"),
        fire.alias("last_fire"))
    tables.write_snapshot(many, job.table("cooldown"), 0)
    events = process_log(spark.createDataFrame(log, LOG_FIELDS), by_ml_score).events
    events = events.withColumn("created_at", F.col("ts"))
    tables.write_batch(events, job.table("events"), 1, date_of="ts")
    job._store_alerts(tables.read_batch(spark, job.table("events"), events.schema, 1), 1)
    written = spark.read.parquet(job.table("fires") + "/batch_id=1")
    fired = job.alerts(spark).groupBy("alert_type").count().count()
    assert 0 < fired <= written.count() < 240 and tables.latest_version(spark, job.table("cooldown")) == 0
    assert job.last_fires(spark, 1).count() == 5000 + written.count()
    job._tidy(spark, 2)
    assert tables.latest_version(spark, job.table("cooldown")) == 1
    assert job.last_fires(spark, 1).count() == 5000 + written.count()


def test_a_half_written_batch_is_not_read(spark, log, tmp_path):
    root = str(tmp_path / "t")
    frame = spark.createDataFrame(log[:5], LOG_FIELDS)
    tables.write_batch(frame, root, 0)
    frame.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{root}/batch_id=1"
    )
    assert tables.read_complete(spark, root).count() == 5


def test_a_batch_has_few_files_however_many_tasks_and_days(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FILE_ROWS", 100)
    spark = spark.newSession()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    root, start = str(tmp_path / "t"), F.to_timestamp_ntz(F.lit("2024-01-01"))
    # Thirteen tasks with seven days each; one day has five times the rows of the others, one row no time.
    nth = F.least(F.col("id") % 11, F.lit(6)).cast("int")
    day = F.date_add(start, nth).cast("timestamp_ntz")
    frame = spark.range(0, 770, numPartitions=13).select(
        "id", F.when(F.col("id") != 5, day).alias("ts"), F.lit("x").alias("path"))
    tables.write_batch(frame, root, 0, date_of="ts")
    files = {}
    for path in (tmp_path / "t" / "batch_id=0").glob("day=*/*.parquet"):
        files.setdefault(path.parent.name, []).append(pq.ParquetFile(path).metadata.num_rows)
    large = files.pop("day=2024-01-07")
    assert 1 < len(large) <= 4 and sum(large) == 350 and max(large) < 200
    assert sorted(map(len, files.values())) == [1] * 7 and files["day=__HIVE_DEFAULT_PARTITION__"] == [1]
    stored = tables.read_complete(spark, root)
    assert sorted(row["id"] for row in stored.collect()) == list(range(770))
    assert stored.where("day = to_date(ts)").count() == 769
    tables.write_batch(frame.where("id < 0"), root, 1, date_of="ts")
    assert tables.read_batch(spark, root, frame.schema, 1).isEmpty()


def test_live_figures(spark, log, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(log, LOG_FIELDS).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(LOG_FIELDS).parquet(source)
    scored = stream.withColumn("anomaly_score", F.col("ml_score"))
    for name, frame, mode in [
        ("totals", running_totals_stream(scored), "complete"),
        ("ticks", events_per_second_stream(stream), "append"),
    ]:
        running = (
            frame.writeStream.format("memory").queryName(name).outputMode(mode)
            .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        )
        assert running.awaitTermination(300)
    totals = spark.table("totals").first()
    assert totals["total_events"] == 240
    assert totals["total_alerts"] == sum(row[6] >= 0.7 for row in log)
    closed = spark.table("ticks").collect()
    newest = max(row[1] for row in log) - dt.timedelta(minutes=1)
    assert sum(row["events"] for row in closed) >= sum(
        row[1] < newest - dt.timedelta(seconds=1) for row in log
    )
