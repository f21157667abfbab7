import datetime as dt
import json

import pytest

from palisade.operators.parse import accepted, parse_log, quarantined

NOW = dt.datetime(2024, 6, 1, 12, 0)


def parsed(spark, messages, **options):
    rows = [(nth, text, NOW) for nth, text in enumerate(messages)]
    frame = spark.createDataFrame(rows, "id bigint, value string, ingest_ts timestamp_ntz")
    return {row["id"]: row for row in parse_log(frame, **options).collect()}


CHANNEL = [
    ('{"source_ip":null,"src_ip":"9.9.9.9"}', {"reject_reason": "null source_ip"}),
    (
        '{"src_ip":"9.9.9.9","status":"404","url":"/x"}',
        {"source_ip": "9.9.9.9", "path": "/x", "status_code": 404, "method": "UNKNOWN"},
    ),
    (
        '{"raw_log":"m"}',
        {"source_ip": "0.0.0.0", "method": "UNKNOWN", "path": "/", "status_code": None,
         "log_source": "unknown", "user_agent": "", "raw_log": "m", "ts": NOW},
    ),
    (
        '"1.2.3.4 - - [15/Jan/2024:10:30:00 +0530] \\"GET /i HTTP/1.1\\" 200 12"',
        {"ts": dt.datetime(2024, 1, 15, 10, 30), "method": "GET", "path": "/i",
         "status_code": 200, "log_source": "http", "source_ip": "1.2.3.4", "user_agent": ""},
    ),
    ('"{\\"source_ip\\":\\"5.5.5.5\\"}"', {"source_ip": "5.5.5.5"}),
    ("42", {"reject_reason": "not an object"}),
    ("[1]", {"reject_reason": "not an object"}),
    ("plain text", {"reject_reason": "not JSON"}),
    ('"\\"42\\""', {"reject_reason": "not an object"}),
    (
        '{"timestamp":"2024-01-15T10:30:00+05:30","status_code":200.7}',
        {"ts": dt.datetime(2024, 1, 15, 10, 30), "status_code": 200},
    ),
    ('{"status_code":true}', {"status_code": 1}),
    ('{"status_code":"200.7"}', {"status_code": None, "reject_reason": None}),
    (
        '"Jan 15 10:30:00 h sshd[12]: Failed password for root from 1.2.3.4 port 22"',
        {"method": "SSH", "path": "/ssh/auth", "status_code": 401, "source_ip": "1.2.3.4",
         "log_source": "ssh", "user_agent": "sshd", "ts": NOW},
    ),
    (
        '"Jan 15 10:30:00 h sshd[12]: Failed password for invalid user bob from 1.2.3.4 port 22"',
        {"reject_reason": "no known text format"},
    ),
    (
        '"Jan 15 10:30:00 h sshd[12]: Accepted publickey for bob from 1.2.3.4"',
        {"status_code": 200, "method": "SSH"},
    ),
    (
        '"1.2.3.4 - bob [15/Jan/2024:10:30:00 +0000] \\"GET / HTTP/1.1\\" 200 -"',
        {"reject_reason": "no known text format"},
    ),
    ('{"method":null,"source_ip":"1.1.1.1"}', {"reject_reason": "null method"}),
    ('{"path":7}', {"reject_reason": "path is not text"}),
    ('{"method":"LONGER-THAN-TEN"}', {"reject_reason": "method longer than 10"}),
    ('{"status_code":3000000000}', {"reject_reason": "status_code out of range"}),
    ('{"timestamp":"","source_ip":"1.1.1.1"}', {"ts": NOW}),
    ('{"timestamp":17}', {"ts": NOW}),
    ('{"timestamp":"2024"}', {"ts": NOW}),
    ('{"timestamp":"20240115T103000"}', {"ts": dt.datetime(2024, 1, 15, 10, 30)}),
    ('{"timestamp":"2024-01-15 10:30:00.25Z"}', {"ts": dt.datetime(2024, 1, 15, 10, 30, 0, 250000)}),
    ("", {"reject_reason": "not JSON"}),
]


def test_channel_messages(spark):
    rows = parsed(spark, [text for text, _ in CHANNEL])
    for nth, (text, expected) in enumerate(CHANNEL):
        found = rows[nth].asDict()
        assert {name: found[name] for name in expected} == expected, text
        if "reject_reason" not in expected:
            assert found["reject_reason"] is None, text


def test_default_raw_log_is_the_record(spark):
    text = json.dumps({"source_ip": "1.1.1.1", "path": "/a b"})
    assert parsed(spark, [text, json.dumps(text)])[0]["raw_log"] == text
    assert parsed(spark, [text, json.dumps(text)])[1]["raw_log"] == text


def test_bare_lines_and_objects(spark):
    rows = parsed(
        spark,
        [
            '203.0.113.77 - - [02/Mar/2023:23:59:01 -0500] "HEAD /static/logo.svg HTTP/1.0" 304 0',
            "kernel: eth0 link is up",
            json.dumps({"source_ip": "198.51.100.9", "method": "DELETE", "path": "/v2/items/8",
                        "status_code": 403, "raw_log": "r8"}),
            "7.5",
            json.dumps({"timestamp": "yesterday noon", "source_ip": "192.0.2.44", "raw_log": "r9"}),
        ],
        decode_first=False,
    )
    assert (rows[0]["source_ip"], rows[0]["path"], rows[0]["status_code"]) == (
        "203.0.113.77", "/static/logo.svg", 304,
    )
    assert rows[1]["reject_reason"] == "no known text format"
    assert (rows[2]["source_ip"], rows[2]["method"]) == ("198.51.100.9", "DELETE")
    assert rows[3]["reject_reason"] == "not an object"
    assert rows[4]["ts"] == NOW


def test_offset_can_be_applied(spark):
    text = '{"timestamp":"2024-01-15T10:30:00+05:30"}'
    assert parsed(spark, [text], to_utc=True)[0]["ts"] == dt.datetime(2024, 1, 15, 5, 0)


def test_accepted_and_quarantined_split_the_messages(spark):
    rows = [(nth, text, NOW) for nth, (text, _) in enumerate(CHANNEL)]
    frame = spark.createDataFrame(rows, "id bigint, value string, ingest_ts timestamp_ntz")
    result = parse_log(frame)
    kept = {row["id"] for row in accepted(result).collect()}
    dropped = {row["id"] for row in quarantined(result).collect()}
    assert kept | dropped == set(range(len(CHANNEL))) and not kept & dropped


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = parsed(
            spark,
            ['"1.2.3.4 - - [10/Mar/2024:02:30:00 +0000] \\"GET / HTTP/1.1\\" 200 1"',
             '{"timestamp":"2024-03-10T02:30:00Z"}'],
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert rows[0]["ts"] == rows[1]["ts"] == dt.datetime(2024, 3, 10, 2, 30)
