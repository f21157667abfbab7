"""Raw messages to normalised log rows, with a reason for each message that is rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import parse
from palisade.functions.steps import computed
from palisade.operators.tables import limit_violation


def parse_log(
    messages: DataFrame,
    value: str = "value",
    now: str = "ingest_ts",
    decode_first: bool = True,
    to_utc: bool = False,
) -> DataFrame:
    """Adds the parsed fields and ``reject_reason`` (null = accepted) to each message.

    A channel message is JSON: an object, or a string that holds an object or a text line.
    With ``decode_first=False`` a message may also be a bare text line or object.
    """
    raw, arrival = F.col(value), F.col(now)
    if decode_first:
        outer = computed(messages, _outer=F.try_parse_json(raw))
        opened = computed(
            outer,
            _object=F.when(parse.starts_json(raw, "{"), F.col("_outer")),
            _inner=F.when(
                parse.starts_json(raw, '"'), F.try_variant_get("_outer", "$", "string")
            ),
        )
    else:
        nothing = F.lit(None).cast("variant")
        opened = computed(messages, _outer=nothing, _object=nothing, _inner=raw)
    inner = F.col("_inner")
    decoded = computed(opened, _second=F.try_parse_json(inner))
    routed = computed(
        decoded,
        _record=F.coalesce(
            F.col("_object"), F.when(parse.starts_json(inner, "{"), F.col("_second"))
        ),
        _source=F.when(F.col("_object").isNotNull(), raw).otherwise(inner),
        _line=F.when(F.col("_second").isNull(), inner),
    )
    record, line = F.col("_record"), F.col("_line")
    opened_record = computed(
        routed,
        **{f"_json_{name}": parse.json_field(record, name) for name in parse.JSON_NAMES},
    )
    json = {name: F.col(f"_json_{name}") for name in parse.JSON_NAMES}
    timed = computed(
        opened_record,
        _json_time=parse.iso_time(parse.json_time_text(json["timestamp"]), to_utc),
        _line_time=F.regexp_extract(line, parse.COMMON_LOG, 2),
    )
    typed = computed(timed, _wrong=parse.wrong_type(json))
    from_json = computed(
        typed,
        _json_log=F.when(
            record.isNotNull(),
            parse.json_log(json, F.col("_json_time"), F.col("_source"), arrival),
        ),
    )
    from_web = computed(
        from_json, _web_log=parse.common_log(line, arrival, F.col("_line_time"))
    )
    from_ssh = computed(from_web, _ssh_log=parse.sshd_log(line, arrival))
    parsed = computed(from_ssh, _log=F.coalesce("_json_log", "_web_log", "_ssh_log"))
    fields = computed(parsed, **{name: F.col(f"_log.{name}") for name in parse.PARSED})
    not_parsed = F.when(
        F.lit(decode_first) & F.col("_outer").isNull(), "not JSON"
    ).when(F.col("_line").isNotNull(), "no known text format").otherwise("not an object")
    reason = F.when(F.col("_log").isNull(), not_parsed).otherwise(
        F.coalesce(F.col("_wrong"), limit_violation(parse.PARSED))
    )
    return fields.select(
        *messages.columns,
        *[
            F.col(name).try_cast("int").alias(name) if name == "status_code" else name
            for name in parse.PARSED
        ],
        reason.alias("reject_reason"),
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantined(parsed: DataFrame, value: str = "value", now: str = "ingest_ts") -> DataFrame:
    keep = [name for name in ("id", value, now) if name in parsed.columns]
    return parsed.where(F.col("reject_reason").isNotNull()).select(*keep, "reject_reason")
