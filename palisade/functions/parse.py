"""Parsing of raw log messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two text formats, the month names and the defaults of absent fields.
COMMON_LOG = (
    r'([\d.]+)\s+-\s+-\s+\[([^\]]+)\]\s+'
    r'"(\w+)\s+(\S+)\s+HTTP/[\d.]+"\s+'
    r'(\d+)\s+(\d+)'
)
SSHD_LOG = (
    r'(\w+\s+\d+\s+[\d:]+)\s+\S+\s+sshd\[\d+\]:\s+'
    r'(Accepted|Failed)\s+\w+\s+for\s+\S+\s+from\s+([\d.]+)'
)
COMMON_LOG_TIME = r'^(\d{1,2})/(\w{3})/(\d{4}):(\d{2}:\d{2}:\d{2}) ([+-]\d{2}:?\d{2}|Z)$'
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
DEFAULT_IP = "0.0.0.0"
DEFAULT_METHOD = "UNKNOWN"
DEFAULT_PATH = "/"
DEFAULT_SOURCE = "unknown"

PARSED = [
    "ts", "source_ip", "dest_ip", "method", "path", "status_code", "user_agent", "log_source",
    "raw_log",
]


def starts_json(text: Column, opening: str) -> Column:
    return text.rlike(r"^[ \t\r\n]*\Q" + opening)


def iso_time(text: Column, to_utc: bool = False) -> Column:
    """Wall-clock time of an ISO-8601 text, null when it is not one.

    The offset is dropped, not applied, unless ``to_utc`` is set.
    """
    extended = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$"), text)
    compact = F.when(
        text.rlike(r"^\d{8}T\d{6}"),
        F.regexp_replace(
            text, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6"
        ),
    )
    iso = F.coalesce(extended, compact)
    if not to_utc:
        return iso.try_cast("timestamp_ntz")
    local = iso.try_cast("timestamp").cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)


def common_log_time(text: Column) -> Column:
    """Wall-clock time of ``15/Jan/2024:10:30:00 +0000``, null when it is not one."""

    def part(nth: int) -> Column:
        return F.regexp_extract(text, COMMON_LOG_TIME, nth)

    month = (F.instr(F.lit(MONTHS), F.initcap(part(2))) + 2) / 3
    return F.when(
        text.rlike(COMMON_LOG_TIME) & (month == F.floor(month)) & (month >= 1),
        F.format_string(
            "%s-%02d-%sT%s", part(3), month.cast("int"), F.lpad(part(1), 2, "0"), part(4)
        ),
    ).try_cast("timestamp_ntz")


def common_log(line: Column, now: Column, time_text: Column | None = None) -> Column:
    """Struct of parsed fields for a common-log-format line, else null."""

    def part(nth: int) -> Column:
        return F.regexp_extract(line, COMMON_LOG, nth)

    return F.when(
        line.rlike(COMMON_LOG),
        F.struct(
            F.coalesce(common_log_time(part(2) if time_text is None else time_text), now).alias("ts"),
            part(1).alias("source_ip"),
            F.lit(None).cast("string").alias("dest_ip"),
            part(3).alias("method"),
            part(4).alias("path"),
            part(5).try_cast("bigint").alias("status_code"),
            F.lit("").alias("user_agent"),
            F.lit("http").alias("log_source"),
            line.alias("raw_log"),
        ),
    )


def sshd_log(line: Column, now: Column) -> Column:
    """Struct of parsed fields for an sshd line, else null. The time is the arrival time."""
    accepted = F.regexp_extract(line, SSHD_LOG, 2) == "Accepted"
    return F.when(
        line.rlike(SSHD_LOG),
        F.struct(
            now.alias("ts"),
            F.regexp_extract(line, SSHD_LOG, 3).alias("source_ip"),
            F.lit(None).cast("string").alias("dest_ip"),
            F.lit("SSH").alias("method"),
            F.lit("/ssh/auth").alias("path"),
            F.when(accepted, 200).otherwise(401).cast("bigint").alias("status_code"),
            F.lit("sshd").alias("user_agent"),
            F.lit("ssh").alias("log_source"),
            line.alias("raw_log"),
        ),
    )


# Each field of a JSON record with the names it may have, first one first.
JSON_NAMES = {
    "timestamp": ["timestamp"],
    "source_ip": ["source_ip", "src_ip"],
    "dest_ip": ["dest_ip", "dst_ip"],
    "method": ["method"],
    "path": ["path", "url"],
    "status_code": ["status_code", "status"],
    "user_agent": ["user_agent"],
    "log_source": ["log_source"],
    "raw_log": ["raw_log"],
}


def json_field(record: Column, name: str) -> Column:
    """A field of a JSON object as a variant. Null means absent; a JSON null is a value."""
    return F.coalesce(
        *[F.try_variant_get(record, f"$.{key}", "variant") for key in JSON_NAMES[name]]
    )


def json_text(field: Column, default: str | None = None) -> Column:
    """Text of a field; only an absent field takes the default."""
    return F.when(field.isNull(), F.lit(default)).otherwise(
        F.try_variant_get(field, "$", "string")
    )


def json_integer(field: Column) -> Column:
    """Numbers are cut to whole ones, texts must hold an integer, booleans are 0 or 1."""
    return F.try_variant_get(field, "$", "bigint")


def json_time_text(field: Column) -> Column:
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(field, "$", "string"))


def json_log(
    fields: dict[str, Column], time: Column, source: Column, now: Column
) -> Column:
    """Struct of parsed fields for a JSON object.

    ``fields`` holds the variants of :func:`json_field`, ``source`` the object's text, which is
    the default of ``raw_log``, and ``time`` the parsed time or null.
    """
    return F.struct(
        F.coalesce(time, now).alias("ts"),
        json_text(fields["source_ip"], DEFAULT_IP).alias("source_ip"),
        json_text(fields["dest_ip"]).alias("dest_ip"),
        json_text(fields["method"], DEFAULT_METHOD).alias("method"),
        json_text(fields["path"], DEFAULT_PATH).alias("path"),
        json_integer(fields["status_code"]).alias("status_code"),
        json_text(fields["user_agent"], "").alias("user_agent"),
        json_text(fields["log_source"], DEFAULT_SOURCE).alias("log_source"),
        F.when(fields["raw_log"].isNull(), source)
        .otherwise(json_text(fields["raw_log"]))
        .alias("raw_log"),
    )


def wrong_type(fields: dict[str, Column]) -> Column:
    """Names the first text field that holds neither a text nor null, else null."""
    texts = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.schema_of_variant(field).alias("kind"))
            for name, field in fields.items()
            if name not in ("timestamp", "status_code")
        ]
    )
    wrong = F.filter(texts, lambda field: ~field["kind"].isin("STRING", "VOID"))
    return F.concat(F.get(wrong, 0)["name"], F.lit(" is not text"))
