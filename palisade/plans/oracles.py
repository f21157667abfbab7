"""The registered queries once more, in SQL for an independent engine."""

from __future__ import annotations

# Fixed values in what follows: addresses, paths and status codes of the derived log, thresholds,
# keywords, names of alert and attack types, and message formats.

LOG = """
blocks AS (
  SELECT *, event_id // 400 AS blk, (event_id // 400) % 4 AS kind FROM events),
access_log AS (
  SELECT event_id AS id,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(blk * 600)
      + to_milliseconds((event_id % 400) * (CASE kind WHEN 0 THEN 10 ELSE 500 END)) AS ts,
    CASE kind WHEN 0 THEN '203.0.113.' || CAST(blk % 5 AS VARCHAR)
              WHEN 1 THEN '198.51.100.' || CAST(user_id % 3 AS VARCHAR)
              WHEN 2 THEN '10.0.0.' || CAST(user_id % 20 AS VARCHAR)
              ELSE '192.168.1.' || CAST(user_id % 50 AS VARCHAR) END AS source_ip,
    CASE WHEN kind = 1 OR event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN kind = 1 THEN '/api/auth/login'
         WHEN kind = 2 AND event_type = 'error' THEN '/wp-admin/install.php'
         WHEN kind = 2 AND event_type = 'view' THEN '/api/../../etc/passwd'
         WHEN event_type = 'signup' THEN '/api/auth/login'
         WHEN event_type = 'purchase' THEN '/api/orders'
         WHEN event_type = 'click' THEN '/index.html'
         ELSE '/api/p' || CAST(user_id % 7 AS VARCHAR) END AS path,
    CAST(CASE WHEN kind = 1 AND event_type <> 'purchase' THEN 401
              WHEN event_type <> 'error' THEN 200
              WHEN user_id % 4 = 0 THEN 403 WHEN user_id % 4 = 1 THEN 404
              WHEN user_id % 4 = 2 THEN 500 ELSE 401 END AS INTEGER) AS status_code,
    least(value / 200.0::DOUBLE, 1.0::DOUBLE) AS ml_score,
    user_id, event_type
  FROM blocks)"""


def _frame(seconds: int) -> str:
    return (
        f"(PARTITION BY source_ip ORDER BY ts "
        f"RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW)"
    )


FEATURES = f"""
feat AS (
  SELECT *,
    count(*) OVER m1 AS ip_req_count_1m,
    count(*) OVER m5 AS ip_req_count_5m,
    count(CASE WHEN status_code >= 400 THEN 1 END) OVER m1 AS ip_fail_count_1m,
    count(CASE WHEN status_code >= 400 THEN 1 END) OVER m5 AS ip_fail_count_5m,
    count(DISTINCT path) OVER {_frame(60)} AS unique_paths_1m,
    avg(coalesce(status_code, 0)) OVER m1 AS avg_status_code_1m,
    CASE WHEN method = 'POST' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_post,
    CASE WHEN contains(path, '/auth') OR contains(path, '/login') OR contains(path, '/ssh')
         THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_auth_endpoint,
    CASE WHEN status_code = 401 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS status_is_401,
    CASE WHEN status_code = 403 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS status_is_403,
    CASE WHEN status_code = 500 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS status_is_500,
    (count(*) OVER s5) / 5.0::DOUBLE AS burst_rate
  FROM access_log
  WINDOW m1 AS {_frame(60)}, m5 AS {_frame(300)}, s5 AS {_frame(5)})"""

_KEYWORDS = [
    "admin", "shell", "passwd", "phpmyadmin", "cgi-bin",
    "..%2f", "../", ".env", "wp-admin", "debug",
]
SUSPICIOUS = " OR ".join(f"contains(lower(path), '{word}')" for word in _KEYWORDS)

RULES = f"""
ruled AS (
  SELECT *,
    CASE WHEN ip_fail_count_1m >= 10 AND is_auth_endpoint > 0 THEN 'brute_force'
         WHEN burst_rate >= 40 THEN 'ddos_spike'
         WHEN {SUSPICIOUS} THEN 'suspicious_api' END AS rule_type,
    CASE WHEN (ip_fail_count_1m >= 10 AND is_auth_endpoint > 0) OR burst_rate >= 40
         THEN 1.0::DOUBLE
         WHEN {SUSPICIOUS} THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS rule_score
  FROM feat)"""


def blend(ml: str = "ml_score", source: str = "ruled", name: str = "scored") -> str:
    return f"""
{name} AS (
  SELECT *,
    least(CASE WHEN rule_score > 0
               THEN greatest(0.6::DOUBLE * ({ml}) + 0.4::DOUBLE * rule_score,
                             rule_score * 0.9::DOUBLE)
               ELSE {ml} END, 1.0::DOUBLE) AS anomaly_score,
    CASE WHEN rule_score > 0 THEN rule_type WHEN ({ml}) > 0.7::DOUBLE THEN 'anomaly' END
      AS attack_type
  FROM {source})"""


SCORED = blend()

CANDIDATES = """
p AS (
  SELECT id, source_ip AS ip, coalesce(attack_type, 'anomaly') AS typ, ts
  FROM scored WHERE anomaly_score >= 0.7::DOUBLE)"""

GATE = """
g AS (
  SELECT ip, typ, min(ts) AS ts FROM p GROUP BY ip, typ
  UNION ALL
  SELECT p.ip, p.typ, min(p.ts) FROM g JOIN p
    ON p.ip = g.ip AND p.typ = g.typ AND p.ts >= g.ts + INTERVAL 60 SECONDS
  GROUP BY p.ip, p.typ),
fired AS (
  SELECT min(p.id) AS id FROM g JOIN p USING (ip, typ, ts) GROUP BY ip, typ, ts)"""

SEVERITY = """CASE WHEN anomaly_score >= 0.95::DOUBLE THEN 'critical'
       WHEN anomaly_score >= 0.85::DOUBLE THEN 'high'
       WHEN anomaly_score >= 0.7::DOUBLE THEN 'medium' ELSE 'low' END"""

ALERTS = f"""
alerts AS (
  SELECT sha256(CAST(s.id AS VARCHAR) || ':' || coalesce(attack_type, 'anomaly')) AS id,
    s.id AS event_id, {SEVERITY} AS severity,
    coalesce(attack_type, 'anomaly') AS alert_type,
    '[' || upper({SEVERITY}) || '] ' || coalesce(attack_type, 'anomaly')
      || ' detected from ' || source_ip || ' | score=' || printf('%.3f', anomaly_score)
      || ' path=' || path || ' status=' || CAST(status_code AS VARCHAR) AS message,
    FALSE AS resolved, CAST(NULL AS VARCHAR) AS resolved_by,
    CAST(NULL AS TIMESTAMP) AS resolved_at, FALSE AS is_false_positive, ts AS created_at
  FROM scored s JOIN fired USING (id))"""

REPUTATION = """
numbered AS (
  SELECT source_ip AS ip, ts, anomaly_score,
    row_number() OVER (PARTITION BY source_ip ORDER BY ts, id) AS k,
    count(*) OVER (PARTITION BY source_ip) AS n
  FROM scored),
reputation AS (
  SELECT ip, count(*) AS total_events,
    count(CASE WHEN anomaly_score >= 0.7::DOUBLE THEN 1 END) AS total_alerts,
    sum(anomaly_score) AS anomaly_sum,
    sum(power(0.9::DOUBLE, n - k) * (CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END)
        * (1.0::DOUBLE - anomaly_score)) AS reputation_score,
    min(ts) AS first_seen, max(ts) AS last_seen
  FROM numbered GROUP BY ip),
tagged AS (
  SELECT *, CASE WHEN reputation_score <= 0.25::DOUBLE THEN 'blocked'
                 WHEN reputation_score <= 0.45::DOUBLE THEN 'suspicious'
                 ELSE 'trusted' END AS tag
  FROM reputation)"""

_PARTS = {
    "log": [LOG],
    "feat": [LOG, FEATURES],
    "ruled": [LOG, FEATURES, RULES],
    "scored": [LOG, FEATURES, RULES, SCORED],
    "gate": [LOG, FEATURES, RULES, SCORED, CANDIDATES, GATE],
    "alerts": [LOG, FEATURES, RULES, SCORED, CANDIDATES, GATE, ALERTS],
    "reputation": [LOG, FEATURES, RULES, SCORED, REPUTATION],
    "all": [LOG, FEATURES, RULES, SCORED, CANDIDATES, GATE, ALERTS, REPUTATION],
}


def sql(stage: str, query: str, *more: str) -> str:
    return "WITH RECURSIVE" + ",".join([*_PARTS[stage], *more]) + "\n" + query


# Analyst feeds, derived from the supplied tables.
LABEL_FEED = """
label_feed AS (
  SELECT doc_id AS event_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'false_positive'
      WHEN quality = 1 THEN 'normal' WHEN toxic = 1 THEN 'attack' ELSE 'spam' END AS label,
    TIMESTAMP '2024-02-01' AS labelled_at
  FROM labels
  UNION ALL
  SELECT item_id, 'attack', TIMESTAMP '2024-02-02' FROM benchmark),
labelled AS (
  SELECT a.*, f.label FROM access_log a LEFT JOIN (
    SELECT event_id, max_by(label, labelled_at) AS label FROM label_feed
    WHERE label IN ('normal', 'attack', 'false_positive') GROUP BY event_id) f
  ON f.event_id = a.id)"""

OVERRIDE_FEED = """
overrides AS (
  SELECT source_ip AS ip, CASE event_type WHEN 'purchase' THEN 'trusted'
      WHEN 'signup' THEN 'suspicious' WHEN 'error' THEN 'blocked' ELSE 'friendly' END AS tag,
    ts + INTERVAL 60 SECONDS AS override_ts
  FROM access_log)"""

RESOLUTION_FEED = """
resolved_alerts AS (
  SELECT a.id, a.event_id, a.severity, a.alert_type, a.message, l.id IS NOT NULL AS resolved,
    CASE WHEN l.event_type = 'signup' THEN 'analyst'
         WHEN l.id IS NOT NULL THEN 'user' || CAST(l.user_id AS VARCHAR) END AS resolved_by,
    l.ts + INTERVAL 3600 SECONDS AS resolved_at,
    coalesce(l.event_type = 'purchase', FALSE) AS is_false_positive, a.created_at
  FROM alerts a LEFT JOIN access_log l
    ON l.id = a.event_id AND l.event_type IN ('signup', 'purchase', 'error'))"""


# The raw messages and their parsing. A JSON field that is absent has no entry in json_keys.
PARSE_STEPS = [
    r"""
messages AS (
  SELECT id, ts + INTERVAL 1 SECOND AS now, CASE id % 10
    WHEN 0 THEN '{"timestamp": "' || iso || '+00:00", "source_ip": "' || source_ip
      || '", "dest_ip": "10.0.0.1", "method": "' || method || '", "path": "' || path
      || '", "status_code": ' || status_code || ', "user_agent": "' || event_type
      || '", "log_source": "http", "raw_log": "r' || id || '"}'
    WHEN 1 THEN '{"timestamp": "' || iso || '+05:30", "src_ip": "' || source_ip
      || '", "dst_ip": "10.0.0.2", "url": "' || path || '", "status": "' || status_code || '"}'
    WHEN 2 THEN '"{\"timestamp\": \"' || iso || '\", \"source_ip\": \"' || source_ip
      || '\", \"path\": \"' || path || '\", \"status_code\": ' || status_code || '.7}"'
    WHEN 3 THEN '"' || source_ip || ' - - [' || clf || ' +0530] \"' || method || ' ' || path
      || ' HTTP/1.1\" ' || status_code || ' 512"'
    WHEN 4 THEN '"' || source_ip || ' - bob [' || clf || ' +0000] \"' || method || ' ' || path
      || ' HTTP/1.1\" ' || status_code || ' -"'
    WHEN 5 THEN '"Jan 15 10:30:00 web sshd[12]: '
      || CASE WHEN status_code >= 400 THEN 'Failed' ELSE 'Accepted' END || ' password for '
      || event_type || ' from ' || source_ip || ' port 22"'
    WHEN 6 THEN '"Jan 15 10:30:00 web sshd[12]: Failed password for invalid user '
      || event_type || ' from ' || source_ip || ' port 22"'
    WHEN 7 THEN '{"source_ip": null, "src_ip": "' || source_ip || '", "method": "' || method
      || '", "status_code": true}'
    WHEN 8 THEN '{"raw_log": "m' || id || '", "timestamp": "not-a-date"}'
    ELSE CAST(id AS VARCHAR) END AS value
  FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS iso,
          strftime(ts, '%d/%b/%Y:%H:%M:%S') AS clf FROM access_log))""",
    r"""
decoded AS (
  SELECT *, CASE WHEN json_type(value) = 'VARCHAR' THEN json_extract_string(value, '$') END AS inside
  FROM messages),
routed AS (
  SELECT *, CASE WHEN json_type(value) = 'OBJECT' THEN value
                 WHEN json_valid(inside) AND json_type(inside) = 'OBJECT' THEN inside END AS doc,
    CASE WHEN NOT json_valid(inside) THEN inside END AS line
  FROM decoded),
matched AS (
  SELECT *, regexp_extract(line,
      '([\d.]+)\s+-\s+-\s+\[([^\]]+)\]\s+"(\w+)\s+(\S+)\s+HTTP/[\d.]+"\s+(\d+)\s+(\d+)',
      ['ip', 'at_time', 'verb', 'target', 'status', 'size']) AS clf,
    regexp_extract(line,
      '(\w+\s+\d+\s+[\d:]+)\s+\S+\s+sshd\[\d+\]:\s+(Accepted|Failed)\s+\w+\s+for\s+\S+\s+from\s+([\d.]+)',
      ['at_time', 'outcome', 'ip']) AS ssh,
    json_keys(doc) AS keys
  FROM routed),
fields AS (
  SELECT id, value, doc, line,
    CASE WHEN doc IS NOT NULL THEN
           coalesce(TRY_CAST(left(json_extract_string(doc, '$.timestamp'), 23) AS TIMESTAMP), now)
         WHEN clf.ip <> '' THEN
           coalesce(try_strptime(left(clf.at_time, 20), '%d/%b/%Y:%H:%M:%S'), now)
         WHEN ssh.ip <> '' THEN now END AS ts,
    CASE WHEN doc IS NOT NULL THEN CASE
           WHEN list_contains(keys, 'source_ip') THEN json_extract_string(doc, '$.source_ip')
           WHEN list_contains(keys, 'src_ip') THEN json_extract_string(doc, '$.src_ip')
           ELSE '0.0.0.0' END
         WHEN clf.ip <> '' THEN clf.ip WHEN ssh.ip <> '' THEN ssh.ip END AS source_ip,
    CASE WHEN list_contains(keys, 'dest_ip') THEN json_extract_string(doc, '$.dest_ip')
         ELSE json_extract_string(doc, '$.dst_ip') END AS dest_ip,
    CASE WHEN doc IS NOT NULL THEN CASE
           WHEN list_contains(keys, 'method') THEN json_extract_string(doc, '$.method')
           ELSE 'UNKNOWN' END
         WHEN clf.ip <> '' THEN clf.verb WHEN ssh.ip <> '' THEN 'SSH' END AS method,
    CASE WHEN doc IS NOT NULL THEN CASE
           WHEN list_contains(keys, 'path') THEN json_extract_string(doc, '$.path')
           WHEN list_contains(keys, 'url') THEN json_extract_string(doc, '$.url') ELSE '/' END
         WHEN clf.ip <> '' THEN clf.target WHEN ssh.ip <> '' THEN '/ssh/auth' END AS path,
    CAST(CASE WHEN doc IS NOT NULL THEN CASE
           WHEN json_type(doc, '$.status_code') = 'BOOLEAN' THEN 1
           ELSE trunc(TRY_CAST(coalesce(json_extract_string(doc, '$.status_code'),
             json_extract_string(doc, '$.status')) AS DOUBLE)) END
         WHEN clf.ip <> '' THEN TRY_CAST(clf.status AS INTEGER)
         WHEN ssh.outcome = 'Accepted' THEN 200 WHEN ssh.outcome = 'Failed' THEN 401 END
      AS INTEGER) AS status_code,
    CASE WHEN doc IS NOT NULL THEN CASE
           WHEN list_contains(keys, 'user_agent') THEN json_extract_string(doc, '$.user_agent')
           ELSE '' END
         WHEN clf.ip <> '' THEN '' WHEN ssh.ip <> '' THEN 'sshd' END AS user_agent,
    CASE WHEN doc IS NOT NULL THEN CASE
           WHEN list_contains(keys, 'log_source') THEN json_extract_string(doc, '$.log_source')
           ELSE 'unknown' END
         WHEN clf.ip <> '' THEN 'http' WHEN ssh.ip <> '' THEN 'ssh' END AS log_source,
    CASE WHEN doc IS NOT NULL THEN CASE
           WHEN list_contains(keys, 'raw_log') THEN json_extract_string(doc, '$.raw_log')
           ELSE doc END
         ELSE line END AS raw_log
  FROM matched),
parsed AS (
  SELECT *, CASE WHEN doc IS NULL AND line IS NULL THEN 'not an object'
                 WHEN doc IS NULL AND log_source IS NULL THEN 'no known text format'
                 WHEN source_ip IS NULL THEN 'null source_ip'
                 WHEN method IS NULL THEN 'null method'
                 WHEN path IS NULL THEN 'null path' END AS reject_reason
  FROM fields)""",
]
