"""Table schemas, closed value domains and column limits."""

from __future__ import annotations

from pyspark.sql import types as T

# The model input is these twelve numbers in this order.
FEATURE_NAMES = [
    "ip_req_count_1m",
    "ip_req_count_5m",
    "ip_fail_count_1m",
    "ip_fail_count_5m",
    "unique_paths_1m",
    "avg_status_code_1m",
    "is_post",
    "is_auth_endpoint",
    "status_is_401",
    "status_is_403",
    "status_is_500",
    "burst_rate",
]

# Closed domains.
EVENT_LABELS = ["normal", "attack", "false_positive"]
IP_TAGS = ["trusted", "suspicious", "blocked", "unknown"]
SEVERITIES = ["low", "medium", "high", "critical"]

# Longest text each column takes, and the columns that may not be null.
EVENT_TEXT_LIMITS = {
    "source_ip": 45,
    "dest_ip": 45,
    "method": 10,
    "path": 2048,
    "user_agent": 512,
    "log_source": 32,
}
# method and path are nullable as columns, but features and rules need them.
EVENT_REQUIRED = ["ts", "source_ip", "method", "path", "raw_log"]

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("log_source", T.StringType()),
        T.StructField("raw_log", T.StringType()),
        T.StructField("ingest_ts", T.TimestampNTZType()),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("severity", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("resolved", T.BooleanType()),
        T.StructField("resolved_by", T.StringType()),
        T.StructField("resolved_at", T.TimestampNTZType()),
        T.StructField("is_false_positive", T.BooleanType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

REPUTATION_SCHEMA = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("total_events", T.LongType()),
        T.StructField("total_alerts", T.LongType()),
        T.StructField("anomaly_sum", T.DoubleType()),
        T.StructField("reputation_score", T.DoubleType()),
        T.StructField("tag", T.StringType()),
        T.StructField("first_seen", T.TimestampNTZType()),
        T.StructField("last_seen", T.TimestampNTZType()),
    ]
)

# Last fired alert per (source_ip, alert_type), carried between micro-batches.
COOLDOWN_SCHEMA = T.StructType(
    [
        T.StructField("source_ip", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("last_fire", T.TimestampNTZType()),
    ]
)
