"""Registered queries: every operator over the supplied tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import parse, rules, scoring
from palisade.functions.steps import computed
from palisade.functions.time import epoch_micros
from palisade.operators import alerts as alert_ops
from palisade.operators import dashboard, features, feedback, reputation, tables
from palisade.operators import scoring as score_ops
from palisade.operators.parse import accepted, parse_log, quarantined
from palisade.operators.quantiles import percentile
from palisade.plans import access_log as source
from palisade.plans.oracles import (
    LABEL_FEED,
    OVERRIDE_FEED,
    PARSE_STEPS,
    RESOLUTION_FEED,
    sql,
)
from palisade.schemas import FEATURE_NAMES
from palisade.session import stored
from palisade.sources import capture

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return register


# --- shared inputs -------------------------------------------------------------------------


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_features(source.access_log(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_ops.hybrid(_featured(spark, sf_dir), F.col("ml_score"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(
        "id", "ts", "source_ip", "method", "path", "status_code", "anomaly_score", "attack_type",
        F.lit(None).cast("string").alias("label"),
        F.col("ts").alias("created_at"),
        "user_id", "event_type",
    )


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_ops.fire_alerts(_scored(spark, sf_dir))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.messages_from(source.access_log(spark, sf_dir))


def _label_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality, toxic = F.col("quality") == 1, F.col("toxic") == 1
    first = source.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("event_id"),
        F.when(quality & toxic, "false_positive")
        .when(quality, "normal")
        .when(toxic, "attack")
        .otherwise("spam")
        .alias("label"),
        F.lit("2024-02-01").cast("timestamp_ntz").alias("labelled_at"),
    )
    second = source.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("event_id"),
        F.lit("attack").alias("label"),
        F.lit("2024-02-02").cast("timestamp_ntz").alias("labelled_at"),
    )
    return first.unionByName(second)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.label_events(_events(spark, sf_dir), _label_feed(spark, sf_dir))


def _override_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return source.access_log(spark, sf_dir).select(
        F.col("source_ip").alias("ip"),
        F.when(kind == "purchase", "trusted")
        .when(kind == "signup", "suspicious")
        .when(kind == "error", "blocked")
        .otherwise("friendly")
        .alias("tag"),
        F.expr("timestampadd(SECOND, 60, ts)").alias("override_ts"),
    )


def _resolution_feed(alerts: DataFrame, log: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    source_events = log.where(kind.isin("signup", "purchase", "error")).select(
        F.col("id").alias("event_id"), "user_id", "event_type", "ts"
    )
    return alerts.join(source_events, "event_id").select(
        F.col("id").alias("alert_id"),
        F.when(kind != "signup", F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias(
            "resolved_by"
        ),
        F.expr("timestampadd(SECOND, 3600, ts)").alias("resolved_at"),
        F.when(kind != "error", kind == "purchase").alias("is_false_positive"),
    )


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = stored(_alerts(spark, sf_dir), "alerts")
    return tables.resolve_alerts(
        alerts, _resolution_feed(alerts, source.access_log(spark, sf_dir))
    )


def _rounded(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({name: F.round(name, 6) for name in names})


# --- features ------------------------------------------------------------------------------

for _name in (
    "ip_req_count_1m", "ip_req_count_5m", "ip_fail_count_1m", "ip_fail_count_5m",
    "unique_paths_1m",
):
    query(_name, sql("feat", f"SELECT id, source_ip, {_name} FROM feat"))(
        lambda spark, sf_dir, name=_name: features.sliding_counts(
            source.access_log(spark, sf_dir)
        ).select("id", "source_ip", name)
    )

query(
    "avg_status_code_1m",
    sql("feat", "SELECT id, source_ip, round(avg_status_code_1m, 6) AS avg_status_code_1m FROM feat"),
)(
    lambda spark, sf_dir: _rounded(
        features.sliding_counts(source.access_log(spark, sf_dir)).select(
            "id", "source_ip", "avg_status_code_1m"
        ),
        "avg_status_code_1m",
    )
)
query("burst_rate", sql("feat", "SELECT id, source_ip, burst_rate FROM feat"))(
    lambda spark, sf_dir: features.sliding_counts(source.access_log(spark, sf_dir)).select(
        "id", "source_ip", "burst_rate"
    )
)

_FLAGS = ["is_post", "is_auth_endpoint", "status_is_401", "status_is_403", "status_is_500"]


@query("binary_flags", sql("feat", f"SELECT id, {', '.join(_FLAGS)} FROM feat"))
def binary_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.binary_flags(source.access_log(spark, sf_dir)).select("id", *_FLAGS)


@query(
    "feature_vector",
    sql(
        "feat",
        "SELECT id, "
        + ", ".join(
            f"round(CAST(CAST({name} AS FLOAT) AS DOUBLE), 4) AS f{nth:02d}"
            for nth, name in enumerate(FEATURE_NAMES)
        )
        + " FROM feat",
    ),
)
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.col("features")
    return _featured(spark, sf_dir).select(
        "id",
        *[
            F.round(vector[nth].cast("double"), 4).alias(f"f{nth:02d}")
            for nth in range(len(FEATURE_NAMES))
        ],
    )


@query(
    "busy_address_features",
    sql(
        "feat",
        """SELECT id, ip_req_count_1m, ip_req_count_5m, ip_fail_count_1m, ip_fail_count_5m,
          unique_paths_1m, round(avg_status_code_1m, 6) AS avg_status_code_1m, burst_rate FROM feat""",
    ),
)
def busy_address_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with more than 300 events in a slice are split by the second."""
    log = source.access_log(spark, sf_dir).select("id", "ts", "source_ip", "path", "status_code")
    counts = features.sliding_counts(log, busy_rows=300)
    return _rounded(counts.drop("ts", "source_ip", "path", "status_code"), "avg_status_code_1m")


def _reset_frame(seconds: int) -> str:
    return (
        "(PARTITION BY source_ip, era ORDER BY ts "
        f"RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW)"
    )


_CLEANUP_SQL = sql(
    "log",
    f"""SELECT id, source_ip, count(*) OVER {_reset_frame(60)} AS ip_req_count_1m,
      count(*) OVER {_reset_frame(300)} AS ip_req_count_5m,
      count(DISTINCT path) OVER {_reset_frame(60)} AS unique_paths_1m
    FROM eras""",
    """
eras AS (
  SELECT *, count(CASE WHEN event_type = 'signup' THEN 1 END) OVER (
    PARTITION BY source_ip ORDER BY ts
    RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS era
  FROM access_log)""",
)


def _cleaned(spark: SparkSession, sf_dir: str, busy_rows: int) -> DataFrame:
    log = source.access_log(spark, sf_dir).select(
        "id", "ts", "source_ip", "path", "status_code", "event_type")
    resets = log.where(F.col("event_type") == "signup").select(
        "source_ip", F.col("ts").alias("reset_at")
    )
    return features.sliding_counts(log, resets=resets, busy_rows=busy_rows).select(
        "id", "source_ip", "ip_req_count_1m", "ip_req_count_5m", "unique_paths_1m"
    )


@query("cleanup_ip", _CLEANUP_SQL)
def cleanup_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, features.DEFAULTS.busy_rows)


@query("busy_address_cleanup", _CLEANUP_SQL)
def busy_address_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with busy addresses, here from 300 events in a slice on, split by the second."""
    return _cleaned(spark, sf_dir, 300)


@query(
    "event_defaults",
    sql(
        "log",
        """SELECT id, CAST(coalesce(CASE WHEN status_code <> 200 THEN status_code END, 0) AS INTEGER)
          AS status_code, upper(lower(method)) AS method FROM access_log""",
    ),
)
def event_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("status_code")
    log = source.access_log(spark, sf_dir).select(
        "id", F.when(status != 200, status).alias("status_code"), F.lower("method").alias("method")
    )
    return features.event_defaults(log)


# --- rules and scores ----------------------------------------------------------------------


def _rule(name: str, condition: str) -> str:
    return sql(
        "feat",
        f"""SELECT id, CASE WHEN {condition} THEN '{name}' END AS rule_type FROM feat""",
    )


@query("rule_brute_force", _rule("brute_force", "ip_fail_count_1m >= 10 AND is_auth_endpoint > 0"))
def rule_brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = rules.brute_force(F.col("ip_fail_count_1m"), F.col("is_auth_endpoint"))
    return _featured(spark, sf_dir).select("id", F.when(hit, "brute_force").alias("rule_type"))


@query("rule_ddos", _rule("ddos_spike", "burst_rate >= 40"))
def rule_ddos(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = rules.ddos_spike(F.col("burst_rate"))
    return _featured(spark, sf_dir).select("id", F.when(hit, "ddos_spike").alias("rule_type"))


@query(
    "rule_suspicious_path",
    sql(
        "ruled",
        """SELECT id, CASE WHEN regexp_matches(lower(path),
          'admin|shell|passwd|phpmyadmin|cgi-bin|\\.\\.%2f|\\.\\./|\\.env|wp-admin|debug')
          THEN 'suspicious_api' END AS rule_type FROM ruled""",
    ),
)
def rule_suspicious_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = rules.suspicious_path(F.col("path"))
    return source.access_log(spark, sf_dir).select(
        "id", F.when(hit, "suspicious_api").alias("rule_type")
    )


@query("apply_rules", sql("ruled", "SELECT id, rule_type, rule_score FROM ruled"))
def apply_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_ops.apply_rules(_featured(spark, sf_dir)).select("id", "rule_type", "rule_score")


@query(
    "hybrid_score",
    sql("scored", "SELECT id, round(anomaly_score, 6) AS anomaly_score, attack_type FROM scored"),
)
def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        _scored(spark, sf_dir).select("id", "anomaly_score", "attack_type"), "anomaly_score"
    )


@query(
    "score_events",
    sql(
        "ruled",
        """SELECT id, 'hybrid' AS mode, round(anomaly_score, 6) AS anomaly_score, attack_type
        FROM hybrid
        UNION ALL SELECT id, 'iforest', round(ml_score, 6),
          CASE WHEN ml_score > 0.7::DOUBLE THEN 'anomaly' END FROM ruled
        UNION ALL SELECT id, 'autoencoder', round(1.0::DOUBLE - ml_score, 6),
          CASE WHEN 1.0::DOUBLE - ml_score > 0.7::DOUBLE THEN 'anomaly' END FROM ruled
        UNION ALL SELECT id, 'other', 0.5::DOUBLE, NULL FROM ruled""",
        """
hybrid AS (
  SELECT id,
    least(CASE WHEN rule_score > 0 THEN greatest(0.3::DOUBLE + 0.4::DOUBLE * rule_score,
      rule_score * 0.9::DOUBLE) ELSE 0.5::DOUBLE END, 1.0::DOUBLE) AS anomaly_score,
    CASE WHEN rule_score > 0 THEN rule_type END AS attack_type
  FROM ruled)""",
    ),
)
def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All score modes, with two stand-in model scores."""
    featured = _featured(spark, sf_dir)
    first, second = F.col("ml_score"), F.lit(1.0) - F.col("ml_score")
    parts = [
        score_ops.score_events(featured, mode, first, second).select(
            "id", F.lit(mode).alias("mode"), F.round("anomaly_score", 6).alias("anomaly_score"),
            "attack_type",
        )
        for mode in ("hybrid", "iforest", "autoencoder", "other")
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    "minmax_normalize",
    """SELECT event_id AS id, round(least(greatest(1.0::DOUBLE - (value - low) / (high - low + 1e-8),
         0.0::DOUBLE), 1.0::DOUBLE), 6) AS score
       FROM events, (SELECT min(value) AS low, max(value) AS high FROM events)""",
)
def minmax_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = source.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value")
    score = score_ops.minmax_scores(values, "value")
    return values.select("id", F.round(score, 6).alias("score"))


@query("iforest_single", "SELECT event_id AS id, 1.0::DOUBLE AS score FROM events")
def iforest_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = source.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value")
    return values.select("id", score_ops.minmax_scores(values, "value", "row").alias("score"))


@query("ae_threshold", "SELECT round(quantile_cont(value, 0.95), 6) AS threshold FROM events")
def ae_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.models.autoencoder import error_threshold

    threshold = error_threshold(source.table(spark, sf_dir, "events"), "value")
    return spark.range(1).select(F.round(F.lit(threshold).cast("double"), 6).alias("threshold"))


@query(
    "ae_score",
    """SELECT event_id AS id, round(least(greatest(value / (t.threshold * 2 + 1e-8), 0.0::DOUBLE),
         1.0::DOUBLE), 6) AS score
       FROM events, (SELECT quantile_cont(value, 0.95) AS threshold FROM events) t""",
)
def ae_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.models.autoencoder import error_threshold

    values = source.table(spark, sf_dir, "events")
    threshold = F.lit(error_threshold(values, "value")).cast("double")
    return values.select(
        F.col("event_id").alias("id"),
        F.round(scoring.error_score(F.col("value"), threshold), 6).alias("score"),
    )


@query(
    "ensemble_score",
    sql("log", "SELECT id, (ml_score + ml_score * ml_score) / 2 AS score FROM access_log"),
)
def ensemble_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("ml_score")
    return source.access_log(spark, sf_dir).select(
        "id", scoring.ensemble_score(first, first * first).alias("score")
    )


# --- alerts --------------------------------------------------------------------------------


@query(
    "alert_candidates",
    sql(
        "scored",
        """SELECT id, source_ip, coalesce(attack_type, 'anomaly') AS alert_type
        FROM scored WHERE anomaly_score >= 0.7::DOUBLE""",
    ),
)
def alert_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_ops.alert_candidates(_scored(spark, sf_dir)).select(
        "id", "source_ip", "alert_type"
    )


@query(
    "alert_severity",
    sql(
        "log",
        """SELECT id, CASE WHEN ml_score >= 0.95::DOUBLE THEN 'critical'
          WHEN ml_score >= 0.85::DOUBLE THEN 'high' WHEN ml_score >= 0.7::DOUBLE THEN 'medium'
          ELSE 'low' END AS severity FROM access_log""",
    ),
)
def alert_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.access_log(spark, sf_dir).select(
        "id", scoring.alert_severity(F.col("ml_score")).alias("severity")
    )


@query(
    "alert_cooldown",
    sql("gate", "SELECT f.id, p.ip AS source_ip, p.typ AS alert_type FROM fired f JOIN p USING (id)"),
)
def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = alert_ops.alert_candidates(_scored(spark, sf_dir)).select(
        "id", "ts", "source_ip", "alert_type"
    )
    return alert_ops.cooldown(stored(candidates, "alert-candidates"))


@query(
    "alert_message",
    sql(
        "log",
        """SELECT id, '[LOW] anomaly detected from ' || source_ip || ' | score='
          || printf('%.3f', ml_score) || ' path='
          || coalesce(CASE WHEN event_type <> 'view' THEN path END, 'None') || ' status='
          || coalesce(CAST(CASE WHEN status_code <> 200 THEN status_code END AS VARCHAR), 'None')
          AS message FROM access_log""",
    ),
)
def alert_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("status_code")
    return source.access_log(spark, sf_dir).select(
        "id",
        alert_ops.alert_message(
            F.lit("low"), F.lit("anomaly"), F.col("source_ip"), F.col("ml_score"),
            F.when(F.col("event_type") != "view", F.col("path")),
            F.when(status != 200, status),
        ).alias("message"),
    )


@query("fire_alerts", sql("alerts", "SELECT * FROM alerts"))
def fire_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir)


# --- reputation ----------------------------------------------------------------------------


@query(
    "reputation_ewma",
    sql("reputation", "SELECT ip, round(reputation_score, 6) AS reputation_score FROM reputation"),
)
def reputation_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        reputation.reputation(_scored(spark, sf_dir)).select("ip", "reputation_score"),
        "reputation_score",
    )


@query(
    "reputation_counters",
    sql(
        "reputation",
        """SELECT ip, total_events, total_alerts, round(anomaly_sum, 6) AS anomaly_sum,
          first_seen, last_seen FROM reputation""",
    ),
)
def reputation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        reputation.reputation(_scored(spark, sf_dir)).select(
            "ip", "total_events", "total_alerts", "anomaly_sum", "first_seen", "last_seen"
        ),
        "anomaly_sum",
    )


@query("reputation_tag", sql("reputation", "SELECT ip, tag FROM tagged"))
def reputation_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.reputation(_scored(spark, sf_dir)).select("ip", "tag")


@query(
    "reputation_lookup",
    sql(
        "reputation",
        """SELECT ip, total_events, round(reputation_score, 6) AS reputation_score, tag
        FROM tagged WHERE ip = '198.51.100.1'""",
    ),
)
def reputation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = reputation.reputation(_scored(spark, sf_dir))
    return _rounded(
        reputation.reputation_lookup(table, "198.51.100.1").select(
            "ip", "total_events", "reputation_score", "tag"
        ),
        "reputation_score",
    )


@query(
    "tag_override",
    sql(
        "reputation",
        """SELECT t.ip, CASE WHEN o.override_ts >= t.last_seen THEN o.tag ELSE t.tag END AS tag
        FROM tagged t LEFT JOIN (
          SELECT ip, max(override_ts) AS override_ts, max_by(tag, override_ts) AS tag
          FROM overrides WHERE tag <> 'friendly' GROUP BY ip) o USING (ip)""",
        OVERRIDE_FEED,
    ),
)
def tag_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = _override_feed(spark, sf_dir)
    table = reputation.reputation(_scored(spark, sf_dir))
    return reputation.override_tags(table, feed.where(tables.valid_tags(feed))).select("ip", "tag")


@query(
    "reputation_merge",
    sql(
        "reputation",
        """SELECT ip, total_events, total_alerts, round(anomaly_sum, 6) AS anomaly_sum,
          round(reputation_score, 6) AS reputation_score, tag, first_seen, last_seen
        FROM tagged""",
    ),
)
def reputation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the time range as a known table, the second half merged into it."""
    scored = stored(
        _scored(spark, sf_dir).select("id", "ts", "source_ip", "anomaly_score"), "scored"
    )
    middle = F.lit(percentile(scored, epoch_micros(F.col("ts")), 0.5)).cast("double")
    early = epoch_micros(F.col("ts")) < middle
    known = reputation.reputation(scored.where(early))
    later = reputation.summarise_events(scored.where(~early))
    return _rounded(
        reputation.merge_reputation(known, later), "anomaly_sum", "reputation_score"
    )


@query(
    "page_bounds",
    """SELECT event_id AS id, event_id % 7 - 2 >= 0 AND user_id * 3 - 9 BETWEEN 1 AND 200 AS accepted
       FROM events""",
)
def page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages may be asked for, with skips and limits from the table's numbers."""
    return source.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        tables.page_accepted(F.col("event_id") % 7 - 2, F.col("user_id") * 3 - 9).alias("accepted"),
    )


# --- listing, counting, updates ------------------------------------------------------------

_EVENT_COLUMNS = ["id", "ts", "source_ip", "path", "status_code", "attack_type"]


@query(
    "list_events",
    sql(
        "scored",
        f"""SELECT {', '.join(_EVENT_COLUMNS)}, round(anomaly_score, 6) AS anomaly_score
        FROM scored WHERE anomaly_score >= 0.8::DOUBLE AND attack_type = 'suspicious_api'
        ORDER BY ts DESC, id OFFSET 10 LIMIT 50""",
    ),
)
def list_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = tables.list_events(
        _events(spark, sf_dir), skip=10, min_score=0.8, attack_type="suspicious_api"
    )
    return _rounded(page.select(*_EVENT_COLUMNS, "anomaly_score"), "anomaly_score")


@query(
    "list_events_by_ip",
    sql(
        "scored",
        f"""SELECT {', '.join(_EVENT_COLUMNS)} FROM scored WHERE source_ip = '10.0.0.3'
        ORDER BY ts DESC, id LIMIT 200""",
    ),
)
def list_events_by_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = tables.list_events(_events(spark, sf_dir), limit=200, source_ip="10.0.0.3")
    return page.select(*_EVENT_COLUMNS)


@query("event_count", 'SELECT count(event_id) AS "count" FROM events')
def event_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.event_count(source.access_log(spark, sf_dir))


@query(
    "get_event",
    sql("scored", f"SELECT {', '.join(_EVENT_COLUMNS)} FROM scored WHERE id = 321"),
)
def get_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.get_event(_events(spark, sf_dir), 321).select(*_EVENT_COLUMNS)


@query(
    "label_event",
    sql("log", "SELECT id, label FROM labelled", LABEL_FEED),
)
def label_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("id", "label")


@query(
    "list_alerts",
    sql(
        "alerts",
        """SELECT id, event_id, severity, alert_type, message, created_at FROM alerts
        WHERE severity = 'critical' AND NOT resolved ORDER BY created_at DESC, id LIMIT 50""",
    ),
)
def list_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = tables.list_alerts(_alerts(spark, sf_dir), severity="critical", resolved=False)
    return page.select("id", "event_id", "severity", "alert_type", "message", "created_at")


@query(
    "alert_stats",
    sql(
        "alerts",
        """SELECT count(*) AS total_alerts, count(CASE WHEN NOT resolved THEN 1 END) AS active_alerts,
          count(CASE WHEN NOT resolved AND severity = 'critical' THEN 1 END) AS critical_active
        FROM resolved_alerts""",
        RESOLUTION_FEED,
    ),
)
def alert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.alert_stats(_resolved(spark, sf_dir))


@query(
    "resolve_alerts",
    sql("alerts", "SELECT * FROM resolved_alerts", RESOLUTION_FEED),
)
def resolve_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@query(
    "resolve_false_positives",
    sql(
        "alerts",
        """SELECT s.id, CASE WHEN r.event_id IS NOT NULL THEN 'false_positive' END AS label
        FROM scored s LEFT JOIN (
          SELECT DISTINCT event_id FROM resolved_alerts WHERE resolved AND is_false_positive) r
          ON r.event_id = s.id""",
        RESOLUTION_FEED,
    ),
)
def resolve_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.label_false_positives(_events(spark, sf_dir), _resolved(spark, sf_dir)).select(
        "id", "label"
    )


@query(
    "overview_stats",
    sql(
        "all",
        """SELECT (SELECT count(*) FROM scored) AS total_events,
          (SELECT count(*) FROM alerts) AS total_alerts,
          (SELECT count(*) FROM alerts WHERE NOT resolved) AS active_alerts,
          (SELECT count(*) FROM tagged WHERE tag = 'blocked') AS blocked_ips,
          (SELECT round(avg(anomaly_score), 6) FROM scored) AS avg_anomaly_score,
          CAST(NULL AS VARCHAR) AS model_version""",
    ),
)
def overview_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = stored(
        _scored(spark, sf_dir).select(
            "id", "ts", "source_ip", "path", "status_code", "anomaly_score", "attack_type"
        ),
        "scored",
    )
    totals = tables.overview(
        scored, alert_ops.fire_alerts(scored, in_storage=True), reputation.reputation(scored)
    )
    return _rounded(totals, "avg_anomaly_score")


@query(
    "event_alerts",
    sql(
        "alerts",
        """SELECT a.id, event_id, severity, source_ip, path, round(anomaly_score, 6) AS anomaly_score
        FROM alerts a JOIN scored s ON s.id = a.event_id""",
    ),
)
def event_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = tables.event_alerts(_events(spark, sf_dir), _alerts(spark, sf_dir))
    return _rounded(
        joined.select("id", "event_id", "severity", "source_ip", "path", "anomaly_score"),
        "anomaly_score",
    )


@query(
    "orphan_alerts",
    sql(
        "alerts",
        """SELECT id, event_id FROM alerts WHERE event_id NOT IN (
          SELECT id FROM access_log WHERE event_type <> 'purchase')""",
    ),
)
def orphan_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _events(spark, sf_dir).where(F.col("event_type") != "purchase")
    return tables.orphan_alerts(kept, _alerts(spark, sf_dir)).select("id", "event_id")


@query(
    "valid_label",
    sql(
        "log",
        """SELECT event_id, label, label IN ('normal', 'attack', 'false_positive') AS accepted
        FROM label_feed""",
        LABEL_FEED,
    ),
)
def valid_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = _label_feed(spark, sf_dir)
    return feed.select("event_id", "label", tables.valid_labels(feed).alias("accepted"))


@query(
    "valid_tag",
    sql(
        "log",
        """SELECT tag, tag IN ('trusted', 'suspicious', 'blocked', 'unknown') AS accepted,
          count(*) AS overrides FROM overrides GROUP BY tag""",
        OVERRIDE_FEED,
    ),
)
def valid_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = _override_feed(spark, sf_dir)
    return (
        feed.withColumn("accepted", tables.valid_tags(feed))
        .groupBy("tag", "accepted")
        .agg(F.count("*").alias("overrides"))
    )


@query(
    "column_limits",
    """SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'null path'
         WHEN length(role) > 10 THEN 'method longer than 10'
         WHEN length(text) > 2048 THEN 'path longer than 2048'
         WHEN length(text) > 512 THEN 'user_agent longer than 512' END AS reject_reason
       FROM conversations""",
)
def column_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as records of unchecked width."""
    rows = source.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("role").alias("method"), F.col("text").alias("path"),
        F.col("text").alias("user_agent"),
    )
    reason = tables.limit_violation(["method", "path", "user_agent"])
    return rows.select("conv_id", "turn", reason.alias("reject_reason"))


# --- live view -----------------------------------------------------------------------------

# Means of few scores often lie on an exact half of the sixth place; those go up on both sides.
_UP = 1e-9


@query(
    "rolling_avg_score",
    sql(
        "scored",
        f"""SELECT id, round({_UP} + avg(anomaly_score) OVER (
          ORDER BY ts, id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 6) AS rolling_avg_score
        FROM scored""",
    ),
)
def rolling_avg_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.round(F.col("rolling_avg_score") + _UP, 6)
    return dashboard.rolling_avg_score(_scored(spark, sf_dir)).select(
        "id", mean.alias("rolling_avg_score")
    )


@query(
    "events_per_second",
    sql("log", "SELECT date_trunc('second', ts) AS tick, count(*) AS events FROM access_log GROUP BY 1"),
)
def events_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.events_per_second(source.access_log(spark, sf_dir))


@query(
    "timeline",
    sql(
        "scored",
        f"""SELECT date_trunc('second', ts) AS tick, count(*) AS events,
          round({_UP} + max_by(mean, nth), 6) AS avg_score
        FROM means GROUP BY 1 ORDER BY 1 DESC LIMIT 60""",
        """
means AS (
  SELECT ts, row_number() OVER (ORDER BY ts, id) AS nth, avg(anomaly_score) OVER (
    ORDER BY ts, id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS mean
  FROM scored)""",
    ),
)
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.timeline(_scored(spark, sf_dir)).withColumn(
        "avg_score", F.round(F.col("avg_score") + _UP, 6)
    )


@query(
    "event_table",
    sql(
        "scored",
        """SELECT id, ts, source_ip, round(anomaly_score, 6) AS anomaly_score,
          CASE WHEN anomaly_score >= 0.9::DOUBLE THEN 'critical'
               WHEN anomaly_score >= 0.7::DOUBLE THEN 'high'
               WHEN anomaly_score >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS score_band
        FROM scored WHERE contains(source_ip, '168.1') AND anomaly_score >= 0.25::DOUBLE
        ORDER BY ts DESC, id DESC LIMIT 200""",
    ),
)
def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dashboard.event_table(_scored(spark, sf_dir), "168.1", 0.25)
    return _rounded(
        rows.select("id", "ts", "source_ip", "anomaly_score", "score_band"), "anomaly_score"
    )


@query(
    "alert_feed",
    sql(
        "scored",
        """SELECT id, ts, source_ip, path, round(anomaly_score, 6) AS anomaly_score,
          coalesce(attack_type, 'anomaly') AS alert_type,
          CASE WHEN anomaly_score >= 0.95::DOUBLE THEN 'critical'
               WHEN anomaly_score >= 0.85::DOUBLE THEN 'high' ELSE 'medium' END AS severity
        FROM scored WHERE anomaly_score >= 0.7::DOUBLE ORDER BY ts DESC, id DESC LIMIT 50""",
    ),
)
def alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dashboard.alert_feed(_scored(spark, sf_dir)), "anomaly_score")


@query(
    "score_band",
    sql(
        "log",
        """SELECT id, CASE WHEN ml_score >= 0.9::DOUBLE THEN 'critical'
          WHEN ml_score >= 0.7::DOUBLE THEN 'high' WHEN ml_score >= 0.5::DOUBLE THEN 'medium'
          ELSE 'low' END AS band FROM access_log""",
    ),
)
def score_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.access_log(spark, sf_dir).select(
        "id", scoring.table_band(F.col("ml_score")).alias("band")
    )


@query(
    "running_totals",
    sql(
        "scored",
        """SELECT id, row_number() OVER (ORDER BY ts, id) AS events_so_far,
          count(CASE WHEN anomaly_score >= 0.7::DOUBLE THEN 1 END) OVER (
            ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS alerts_so_far
        FROM scored""",
    ),
)
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.running_totals(_scored(spark, sf_dir)).select(
        "id", "events_so_far", "alerts_so_far"
    )


# --- feedback ------------------------------------------------------------------------------


@query(
    "feedback_count",
    sql(
        "log",
        """SELECT count(CASE WHEN label IN ('normal', 'false_positive') THEN 1 END)
            AS feedback_events,
          count(CASE WHEN label IN ('normal', 'false_positive') THEN 1 END) >= 50 AS enough
        FROM labelled""",
        LABEL_FEED,
    ),
)
def feedback_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.feedback_count(_labelled(spark, sf_dir))


@query(
    "training_rows",
    sql(
        "log",
        """SELECT id, label FROM labelled WHERE label = 'normal' OR label IS NULL
        ORDER BY id LIMIT 10000""",
        LABEL_FEED,
    ),
)
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    return feedback.training_rows(labelled, feedback.MAX_TRAINING_ROWS).select("id", "label")


# --- payloads and capture ------------------------------------------------------------------


@query(
    "publish_log",
    sql(
        "log",
        """SELECT '{"id":' || id || ',"source_ip":"' || source_ip || '","method":"' || method
          || '","path":"' || path || '","status_code":' || status_code || ',"user_agent":null}'
          AS value FROM access_log""",
    ),
)
def publish_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.publish_log(
        source.access_log(spark, sf_dir).select(
            "id", "source_ip", "method", "path", "status_code",
            F.lit(None).cast("string").alias("user_agent"),
        )
    )


def _payload_parts(feed: DataFrame, place: str) -> DataFrame:
    """The score as a number, since engines print its last digits differently, and the other text."""
    score = F.get_json_object("payload", place).cast("double")
    return feed.select(
        "id",
        F.round(score, 6).alias("anomaly_score"),
        F.regexp_replace("payload", '"anomaly_score":[^,}]+', '"anomaly_score":0').alias("payload"),
    )


_ISO = """strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0
  THEN strftime(ts, '.%f') ELSE '' END"""


@query(
    "live_feed",
    sql(
        "scored",
        f"""SELECT id, round(anomaly_score, 6) AS anomaly_score,
          '{{"event":{{"id":"' || id || '","timestamp":"' || {_ISO}
          || '","source_ip":"' || source_ip || '","method":"' || method || '","path":"' || path
          || '","status_code":' || status_code || ',"anomaly_score":0,"attack_type":'
          || coalesce('"' || attack_type || '"', 'null') || '}}}}' AS payload FROM scored""",
    ),
)
def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payload_parts(capture.live_feed(_scored(spark, sf_dir)), "$.event.anomaly_score")


@query(
    "live_feed_flat",
    sql(
        "scored",
        f"""SELECT id, round(anomaly_score, 6) AS anomaly_score,
          '{{"event_id":"' || id || '","timestamp":"' || {_ISO}
          || '","source_ip":"' || source_ip || '","method":"' || method || '","path":"' || path
          || '","status_code":' || status_code || ',"anomaly_score":0,"attack_type":'
          || coalesce('"' || attack_type || '"', 'null') || ',"severity":"'
          || CASE WHEN anomaly_score >= 0.95::DOUBLE THEN 'critical' WHEN anomaly_score >= 0.85::DOUBLE THEN 'high'
                  WHEN anomaly_score >= 0.7::DOUBLE THEN 'medium' ELSE 'low' END || '"}}' AS payload
        FROM scored""",
    ),
)
def live_feed_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payload_parts(capture.live_feed(_scored(spark, sf_dir), nested=False), "$.anomaly_score")


@query(
    "alert_outbox",
    sql(
        "alerts",
        f"""SELECT message AS text, severity, source_ip, round(anomaly_score, 6) AS score,
          {_ISO} AS "timestamp" FROM alerts a JOIN scored s ON s.id = a.event_id""",
    ),
)
def alert_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    outbox = capture.alert_outbox(_alerts(spark, sf_dir), _events(spark, sf_dir))
    return _rounded(outbox, "score")


@query(
    "http_capture",
    f"""WITH requests AS (
      SELECT page_id, CAST(page_id AS VARCHAR) AS number,
        TIMESTAMP '2024-05-01' + to_milliseconds(page_id * 250) AS ts,
        regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS rest, length(html) % 3 AS kind
      FROM pages),
    paths AS (
      SELECT *, regexp_extract(rest, '[?](.*)$', 1) AS query,
        '/' || split_part(rest, '?', 1) || CASE WHEN contains(rest, '?')
        AND length(regexp_extract(rest, '[?](.*)$', 1)) > 0
        THEN '?' || regexp_extract(rest, '[?](.*)$', 1) ELSE '' END AS path FROM requests)
    SELECT page_id AS id,
      CASE WHEN kind = 0 THEN '203.0.113.' || number ELSE '172.16.0.' || number END AS source_ip,
      'honeypot' AS dest_ip, 'GET' AS method, path,
      CAST(CASE WHEN regexp_matches(path, 'admin|login|wp-|config|env|api') THEN 200 ELSE 404 END
        AS INTEGER) AS status_code,
      'probe' AS user_agent, 'http' AS log_source, {_ISO} AS "timestamp",
      '{{"headers":{{"x_forwarded_for":' || CASE kind WHEN 0 THEN '" 203.0.113.' || number || ' , 10.0.0.1"'
        WHEN 1 THEN '""' ELSE 'null' END || ',"user_agent":"probe"}},"query":'
        || CAST(to_json(query) AS VARCHAR) || '}}' AS raw_log
    FROM paths""",
)
def http_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.capture_log(source.captured_requests(spark, sf_dir))


# --- parsing -------------------------------------------------------------------------------


def _parsed_sql(columns: str, where: str = "TRUE") -> str:
    return sql("log", f"SELECT {columns} FROM parsed WHERE {where}", *PARSE_STEPS)


_PARSED_TEXT = (
    "source_ip, dest_ip, method, path, status_code, user_agent, log_source, raw_log"
)


@query("decode_log", _parsed_sql(f"id, ts, {_PARSED_TEXT}", "reject_reason IS NULL"))
def decode_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(parse_log(_messages(spark, sf_dir))).drop("value", "ingest_ts")


@query("quarantine", _parsed_sql("id, value, reject_reason", "reject_reason IS NOT NULL"))
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantined(parse_log(_messages(spark, sf_dir))).drop("ingest_ts")


@query(
    "normalize_log",
    sql(
        "log",
        """SELECT id, coalesce(CASE WHEN event_type <> 'view' THEN source_ip END,
            CASE WHEN event_type = 'view' AND status_code = 200 THEN source_ip || '9' END, '0.0.0.0')
            AS source_ip,
          coalesce(CASE WHEN event_type = 'error' THEN method END, 'UNKNOWN') AS method,
          coalesce(CASE WHEN event_type = 'click' THEN path END,
            CASE WHEN event_type = 'error' THEN path || '#' END, '/') AS path,
          '' AS user_agent, 'unknown' AS log_source
        FROM access_log""",
    ),
)
def normalize_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with some fields absent, some under their alias names."""
    kind = F.col("event_type")
    record = F.to_json(
        F.struct(
            F.when(kind != "view", F.col("source_ip")).alias("source_ip"),
            F.when(
                (kind == "view") & (F.col("status_code") == 200), F.concat("source_ip", F.lit("9"))
            ).alias("src_ip"),
            F.when(kind == "error", F.col("method")).alias("method"),
            F.when(kind == "click", F.col("path")).alias("path"),
            F.when(kind == "error", F.concat("path", F.lit("#"))).alias("url"),
        )
    )
    messages = source.access_log(spark, sf_dir).select(
        "id", record.alias("value"), F.col("ts").alias("ingest_ts")
    )
    return parse_log(messages).select(
        "id", "source_ip", "method", "path", "user_agent", "log_source"
    )


@query(
    "safe_int",
    sql(
        "log",
        """SELECT id, CAST(CASE event_type WHEN 'view' THEN trunc(status_code + ml_score * 0.9)
            WHEN 'click' THEN status_code WHEN 'purchase' THEN NULL WHEN 'signup' THEN 1
            ELSE NULL END AS BIGINT) AS status FROM access_log""",
    ),
)
def safe_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, padded texts, decimal texts, booleans and nulls as integers."""
    kind, status = F.col("event_type"), F.col("status_code")
    text = (
        F.when(kind == "view", F.format_string("%.6f", status + F.col("ml_score") * 0.9))
        .when(kind == "click", F.format_string('" %d "', status))
        .when(kind == "purchase", F.format_string('"%d.7"', status))
        .when(kind == "signup", "true")
        .otherwise("null")
    )
    record = F.try_parse_json(F.concat(F.lit('{"status": '), text, F.lit("}")))
    return source.access_log(spark, sf_dir).select(
        "id", parse.json_integer(parse.json_field(record, "status_code")).alias("status")
    )


@query(
    "normalize_ts",
    sql(
        "log",
        """SELECT id, CASE event_type WHEN 'view' THEN ts WHEN 'click' THEN ts
            WHEN 'error' THEN date_trunc('day', ts)
            ELSE ts + INTERVAL 1 SECOND END AS ts FROM access_log""",
    ),
)
def normalize_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO texts with and without offset, dates, empty and broken texts."""
    kind = F.col("event_type")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    text = (
        F.when(kind == "view", F.concat(iso, F.lit("+05:30")))
        .when(kind == "click", iso)
        .when(kind == "error", F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == "signup", "")
        .otherwise(F.concat(F.lit("at "), iso))
    )
    now = F.expr("timestampadd(SECOND, 1, ts)")
    return source.access_log(spark, sf_dir).select(
        "id", F.coalesce(parse.iso_time(text), now).alias("ts")
    )


_TEXT_LOG = r"""
lines AS (
  SELECT id, ts, CASE event_type
    WHEN 'view' THEN 'edge7 ' || source_ip || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S')
      || ' +0530] "' || method || ' ' || path || ' HTTP/1.1" ' || status_code || ' 77'
    WHEN 'click' THEN source_ip || ' - - [soon] "' || method || ' ' || path || ' HTTP/2" '
      || status_code || ' 1'
    WHEN 'error' THEN 'Jan  5 10:30:00 web sshd[7]: Failed password for root from ' || source_ip
      || ' port 22'
    WHEN 'signup' THEN 'Jan 15 10:30:00 web sshd[12]: Accepted publickey for u' || user_id
      || ' from ' || source_ip
    ELSE method || ' ' || path END AS line
  FROM access_log),
matched AS (
  SELECT *, regexp_extract(line,
    '([\d.]+)\s+-\s+-\s+\[([^\]]+)\]\s+"(\w+)\s+(\S+)\s+HTTP/[\d.]+"\s+(\d+)\s+(\d+)',
    ['ip', 'at_time', 'verb', 'target', 'status', 'size']) AS clf,
   regexp_extract(line,
    '(\w+\s+\d+\s+[\d:]+)\s+\S+\s+sshd\[\d+\]:\s+(Accepted|Failed)\s+\w+\s+for\s+\S+\s+from\s+([\d.]+)',
    ['at_time', 'outcome', 'ip']) AS ssh
  FROM lines)"""


def _text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    line = (
        F.when(
            kind == "view",
            F.format_string(
                'edge7 %s - - [%s +0530] "%s %s HTTP/1.1" %d 77', F.col("source_ip"),
                F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.col("method"), F.col("path"),
                F.col("status_code"),
            ),
        )
        .when(
            kind == "click",
            F.format_string(
                '%s - - [soon] "%s %s HTTP/2" %d 1', F.col("source_ip"), F.col("method"),
                F.col("path"), F.col("status_code"),
            ),
        )
        .when(
            kind == "error",
            F.format_string(
                "Jan  5 10:30:00 web sshd[7]: Failed password for root from %s port 22",
                F.col("source_ip"),
            ),
        )
        .when(
            kind == "signup",
            F.format_string(
                "Jan 15 10:30:00 web sshd[12]: Accepted publickey for u%d from %s",
                F.col("user_id"), F.col("source_ip"),
            ),
        )
        .otherwise(F.concat_ws(" ", "method", "path"))
    )
    return source.access_log(spark, sf_dir).select(
        "id", line.alias("line"), F.expr("timestampadd(SECOND, 1, ts)").alias("now")
    )


_CLF_TIME = "coalesce(try_strptime(left(clf.at_time, 20), '%d/%b/%Y:%H:%M:%S'), ts + INTERVAL 1 SECOND)"
_CLF_SQL = f"""SELECT id, {_CLF_TIME} AS ts, clf.ip AS source_ip, clf.verb AS method,
  clf.target AS path, CAST(clf.status AS BIGINT) AS status_code, 'http' AS log_source
FROM matched WHERE clf.ip <> ''"""
_SSH_SQL = """SELECT id, ts + INTERVAL 1 SECOND AS ts, ssh.ip AS source_ip, 'SSH' AS method,
  '/ssh/auth' AS path, CAST(CASE ssh.outcome WHEN 'Accepted' THEN 200 ELSE 401 END AS BIGINT)
    AS status_code, 'ssh' AS log_source
FROM matched WHERE ssh.ip <> ''"""


def _text_fields(lines: DataFrame, log: str) -> DataFrame:
    names = ["ts", "source_ip", "method", "path", "status_code", "log_source"]
    return lines.where(F.col(log).isNotNull()).select(
        "id", *[F.col(f"{log}.{name}").alias(name) for name in names]
    )


@query("parse_clf", sql("log", _CLF_SQL, _TEXT_LOG))
def parse_clf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _text_lines(spark, sf_dir)
    return _text_fields(
        computed(lines, log=parse.common_log(F.col("line"), F.col("now"))), "log"
    )


@query(
    "parse_clf_time",
    sql("log", f"SELECT id, {_CLF_TIME} AS ts FROM matched WHERE clf.ip <> ''", _TEXT_LOG),
)
def parse_clf_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _text_lines(spark, sf_dir)
    written = F.regexp_extract("line", parse.COMMON_LOG, 2)
    return lines.where(F.col("line").rlike(parse.COMMON_LOG)).select(
        "id", F.coalesce(parse.common_log_time(written), "now").alias("ts")
    )


@query("parse_sshd", sql("log", _SSH_SQL, _TEXT_LOG))
def parse_sshd(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _text_lines(spark, sf_dir)
    return _text_fields(
        computed(lines, log=parse.sshd_log(F.col("line"), F.col("now"))), "log"
    )


@query("parse_text", sql("log", f"{_CLF_SQL} UNION ALL {_SSH_SQL}", _TEXT_LOG))
def parse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _text_lines(spark, sf_dir)
    matched = computed(
        computed(
            lines,
            web=parse.common_log(F.col("line"), F.col("now")),
            ssh=parse.sshd_log(F.col("line"), F.col("now")),
        ),
        log=F.coalesce("web", "ssh"),
    )
    return _text_fields(matched, "log")
