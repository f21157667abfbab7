"""Log data that Spark derives from the supplied ``events`` and ``pages`` tables.

Blocks of 400 events imitate, in turn, a flood, a password attack, a scan and normal traffic.
The derivation is a projection, so it grows with the table. Text forms of the same rows feed
the parsers.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def access_log_from(events: DataFrame) -> DataFrame:
    user, kind_of = F.col("user_id"), F.col("event_type")
    blocked = events.select(
        F.col("event_id").alias("id"),
        "user_id",
        "event_type",
        "value",
        F.expr(f"event_id div {BLOCK}").alias("blk"),
        F.expr(f"(event_id div {BLOCK}) % 4").alias("kind"),
        F.expr(f"event_id % {BLOCK}").alias("nth"),
    )
    kind = F.col("kind")

    def numbered(prefix: str, number: Column) -> Column:
        return F.concat(F.lit(prefix), number.cast("string"))

    return blocked.select(
        "id",
        F.expr(
            "timestampadd(MILLISECOND, nth * IF(kind = 0, 10, 500), "
            "timestampadd(SECOND, blk * 600, TIMESTAMP_NTZ'2024-01-01 00:00:00'))"
        ).alias("ts"),
        F.when(kind == 0, numbered("203.0.113.", F.col("blk") % 5))
        .when(kind == 1, numbered("198.51.100.", user % 3))
        .when(kind == 2, numbered("10.0.0.", user % 20))
        .otherwise(numbered("192.168.1.", user % 50))
        .alias("source_ip"),
        F.when((kind == 1) | kind_of.isin("signup", "purchase"), "POST")
        .otherwise("GET")
        .alias("method"),
        F.when(kind == 1, "/api/auth/login")
        .when((kind == 2) & (kind_of == "error"), "/wp-admin/install.php")
        .when((kind == 2) & (kind_of == "view"), "/api/../../etc/passwd")
        .when(kind_of == "signup", "/api/auth/login")
        .when(kind_of == "purchase", "/api/orders")
        .when(kind_of == "click", "/index.html")
        .otherwise(numbered("/api/p", user % 7))
        .alias("path"),
        F.when((kind == 1) & (kind_of != "purchase"), 401)
        .when(kind_of != "error", 200)
        .when(user % 4 == 0, 403)
        .when(user % 4 == 1, 404)
        .when(user % 4 == 2, 500)
        .otherwise(401)
        .alias("status_code"),
        F.least(F.col("value") / F.lit(200.0), F.lit(1.0)).alias("ml_score"),
        "user_id",
        "event_type",
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_log_from(table(spark, sf_dir, "events"))


def messages_from(log: DataFrame) -> DataFrame:
    """One channel message per log row, in ten spellings a collector meets.

    JSON objects with usual names, alias names, absent or null fields, objects inside JSON
    strings, common-log and sshd lines inside JSON strings, bare lines and other JSON values.
    """
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    clf_time = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    ip, method, path, agent = (
        F.col("source_ip"), F.col("method"), F.col("path"), F.col("event_type"),
    )
    status = F.col("status_code").cast("string")
    plain = F.format_string(
        '{"timestamp": "%s+00:00", "source_ip": "%s", "dest_ip": "10.0.0.1", "method": "%s", '
        '"path": "%s", "status_code": %s, "user_agent": "%s", "log_source": "http", '
        '"raw_log": "r%s"}',
        iso, ip, method, path, status, agent, F.col("id").cast("string"),
    )
    aliased = F.format_string(
        '{"timestamp": "%s+05:30", "src_ip": "%s", "dst_ip": "10.0.0.2", "url": "%s", '
        '"status": "%s"}',
        iso, ip, path, status,
    )
    nested = F.format_string(
        '"{\\"timestamp\\": \\"%s\\", \\"source_ip\\": \\"%s\\", \\"path\\": \\"%s\\", '
        '\\"status_code\\": %s.7}"',
        iso, ip, path, status,
    )
    clf = F.format_string(
        '"%s - - [%s +0530] \\"%s %s HTTP/1.1\\" %s 512"', ip, clf_time, method, path, status
    )
    clf_named = F.format_string(
        '"%s - bob [%s +0000] \\"%s %s HTTP/1.1\\" %s -"', ip, clf_time, method, path, status
    )
    ssh = F.format_string(
        '"Jan 15 10:30:00 web sshd[12]: %s password for %s from %s port 22"',
        F.when(F.col("status_code") >= 400, "Failed").otherwise("Accepted"), agent, ip,
    )
    ssh_invalid = F.format_string(
        '"Jan 15 10:30:00 web sshd[12]: Failed password for invalid user %s from %s port 22"',
        agent, ip,
    )
    nulls = F.format_string(
        '{"source_ip": null, "src_ip": "%s", "method": "%s", "status_code": true}', ip, method
    )
    minimal = F.format_string('{"raw_log": "m%s", "timestamp": "not-a-date"}', F.col("id").cast("string"))
    number = F.col("id").cast("string")
    spelling = F.col("id") % 10
    value = F.when(spelling == 0, plain)
    for nth, text in enumerate(
        [aliased, nested, clf, clf_named, ssh, ssh_invalid, nulls, minimal, number], start=1
    ):
        value = value.when(spelling == nth, text)
    return log.select(
        "id",
        value.alias("value"),
        F.expr("timestampadd(SECOND, 1, ts)").alias("ingest_ts"),
    )


def captured_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured HTTP requests, one per page: peer, forwarded header, path, query and time."""
    page = table(spark, sf_dir, "pages")
    number = F.col("page_id").cast("string")
    after_host = F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1)
    forwarded = (
        F.when(F.length("html") % 3 == 0, F.concat(F.lit(" 203.0.113."), number, F.lit(" , 10.0.0.1")))
        .when(F.length("html") % 3 == 1, "")
    )
    return page.select(
        F.col("page_id").alias("id"),
        F.concat(F.lit("172.16.0."), number).alias("peer_ip"),
        forwarded.alias("x_forwarded_for"),
        F.lit("GET").alias("method"),
        F.substring_index(after_host, "?", 1).alias("path"),
        F.when(after_host.contains("?"), F.regexp_extract(after_host, "[?](.*)$", 1))
        .otherwise("")
        .alias("query"),
        F.lit("probe").alias("user_agent"),
        F.expr("timestampadd(MILLISECOND, page_id * 250, timestamp_ntz '2024-05-01')").alias("captured_at"),
    )
