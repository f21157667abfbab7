"""Captured HTTP requests and outgoing payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.rules import contains_any
from palisade.functions.scoring import alert_severity
from palisade.functions.time import iso_format

# Path parts that are answered with 200, and the target name of captured requests.
BAIT_PATH_PARTS = ["admin", "login", "wp-", "config", "env", "api"]
CAPTURE_TARGET = "honeypot"


def capture_log(requests: DataFrame, ts: str = "captured_at") -> DataFrame:
    """Log records of captured requests.

    ``requests`` is (peer_ip, x_forwarded_for, method, path, query, user_agent, captured_at, ...). The
    client is the first forwarded address when there is one, else the peer. ``timestamp`` is the text
    that the parser reads, so a published record enters the windows at the time of its capture.
    """
    forwarded = F.when(F.length("x_forwarded_for") > 0, F.col("x_forwarded_for"))
    client = F.regexp_replace(F.substring_index(forwarded, ",", 1), r"(?U)^\s+|\s+$", "")
    query = F.when(F.length("query") > 0, F.concat(F.lit("?"), "query")).otherwise("")
    path = F.concat(F.lit("/"), "path", query)
    return requests.select(
        "id",
        F.coalesce(client, "peer_ip", F.lit("127.0.0.1")).alias("source_ip"),
        F.lit(CAPTURE_TARGET).alias("dest_ip"),
        "method",
        path.alias("path"),
        F.when(contains_any(path, BAIT_PATH_PARTS), 200).otherwise(404).alias("status_code"),
        F.coalesce("user_agent", F.lit("")).alias("user_agent"),
        F.lit("http").alias("log_source"),
        F.to_json(
            F.struct(F.struct("x_forwarded_for", "user_agent").alias("headers"), "query"),
            {"ignoreNullFields": "false"},
        ).alias("raw_log"),
        iso_format(F.col(ts)).alias("timestamp"),
    )


def as_json(columns: list[str | Column]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def publish_log(log: DataFrame) -> DataFrame:
    """One JSON text per record, ready for a text or Kafka sink."""
    return log.select(as_json([F.col(name) for name in log.columns]).alias("value"))


def live_feed(events: DataFrame, ts: str = "ts", nested: bool = True) -> DataFrame:
    """JSON payload per scored event, nested under ``event`` or flat with a severity."""
    common = [
        iso_format(F.col(ts)).alias("timestamp"),
        *[F.col(name) for name in (
            "source_ip", "method", "path", "status_code", "anomaly_score", "attack_type",
        )],
    ]
    key = F.col("id").cast("string")
    if nested:
        payload = as_json([F.struct(key.alias("id"), *common).alias("event")])
    else:
        severity = alert_severity(F.col("anomaly_score")).alias("severity")
        payload = as_json([key.alias("event_id"), *common, severity])
    return events.select("id", payload.alias("payload"))


def alert_outbox(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Notification rows for a delivery service: text, severity, address, score and time."""
    source = events.select(F.col("id").alias("event_id"), "source_ip", "anomaly_score")
    return alerts.join(source, "event_id").select(
        F.col("message").alias("text"),
        "severity",
        "source_ip",
        F.col("anomaly_score").alias("score"),
        iso_format(F.col("created_at")).alias("timestamp"),
    )
