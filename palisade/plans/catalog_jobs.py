"""Registered queries that run whole jobs: streams, sinks, model training and scoring."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.time import epoch_micros
from palisade.models.autoencoder import THRESHOLD_PERCENTILE, Autoencoder
from palisade.models.isolation_forest import CONTAMINATION, IsolationForest
from palisade.models.registry import Models, load_models, retrain, train_models
from palisade.operators.feedback import training_rows
from palisade.operators.parse import accepted, parse_log
from palisade.operators.scoring import hybrid
from palisade.operators.tables import label_events
from palisade.plans import access_log as source
from palisade.plans.catalog import (
    _PARSED_TEXT,
    _featured,
    _label_feed,
    _messages,
    _override_feed,
    _parsed_sql,
    _resolution_feed,
    _rounded,
    query,
)
from palisade.plans.jobs import process_log
from palisade.plans.oracles import LABEL_FEED, OVERRIDE_FEED, RESOLUTION_FEED, sql
from palisade.schemas import FEATURE_NAMES
from palisade.session import stored, work_folder
from palisade.sources.raw import raw_stream, with_arrival
from palisade.streaming.dashboard import events_per_second_stream, running_totals_stream
from palisade.streaming.features import features_stream
from palisade.streaming.flow import Flow


def _finish(running) -> None:
    try:
        running.awaitTermination()
    finally:
        running.stop()


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of access-log rows."""
    schema = source.table(spark, sf_dir, "events").schema
    path = os.path.join(sf_dir, "events.parquet")
    reader = spark.readStream.schema(schema)
    if path.startswith("/") and os.path.isfile(path):  # one local file instead of a folder
        reader, path = reader.option("pathGlobFilter", "events.parquet"), sf_dir
    return with_arrival(source.access_log_from(reader.parquet(path)))


def _stand_in(featured: DataFrame, _: Models) -> DataFrame:
    return hybrid(featured, F.col("ml_score"))


def _run_flow(spark: SparkSession, sf_dir: str) -> Flow:
    flow = Flow(work_folder(spark, "flow"), score=_stand_in)
    _finish(
        flow.start(
            _event_stream(spark, sf_dir), work_folder(spark, "flow-checkpoint"), available_now=True
        )
    )
    return flow


def _run_part(spark: SparkSession, flow: Flow, rows: DataFrame) -> None:
    """Lets more rows arrive at the job, and waits until they are done."""
    channel = f"{flow.root}-in"
    rows.write.mode("append").parquet(channel)
    arriving = with_arrival(spark.readStream.schema(rows.schema).parquet(channel))
    _finish(flow.start(arriving, f"{flow.root}-checkpoint", available_now=True))


# --- streams -------------------------------------------------------------------------------


@query("raw_stream", _parsed_sql(_PARSED_TEXT, "reject_reason IS NULL"))
def raw_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages through a text folder, read as a stream and parsed."""
    channel, target = work_folder(spark, "channel"), work_folder(spark, "parsed")
    _messages(spark, sf_dir).select("value").write.text(channel)
    parsed = accepted(parse_log(raw_stream(spark, channel))).drop("value", "ingest_ts", "ts")
    running = (
        parsed.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", work_folder(spark, "parsed-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    _finish(running)
    return spark.read.schema(parsed.schema).parquet(target)


def _landed(spark: SparkSession, stream: DataFrame, mode: str, purpose: str) -> DataFrame:
    """What a stream of figures has given out when all its input is done."""
    out = work_folder(spark, purpose)

    def keep(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":  # every batch holds all figures
            batch.write.mode("overwrite").parquet(out)
        else:
            batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep)
    _finish(
        writer.option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


@query(
    "events_per_second_stream",
    sql(
        "log",
        # A tick is given out once nothing can fall in it any more: the newest minute is still open.
        """SELECT date_trunc('second', ts) AS tick, count(*) AS events FROM access_log GROUP BY 1
        HAVING date_trunc('second', ts) + INTERVAL 1 SECOND <=
          (SELECT max(date_trunc('milliseconds', ts)) - INTERVAL 1 MINUTE FROM access_log)""",
    ),
)
def events_per_second_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(
        spark, events_per_second_stream(_event_stream(spark, sf_dir)), "append", "ticks")


@query(
    "running_totals_stream",
    sql(
        "scored",
        """SELECT count(*) AS total_events, count(CASE WHEN anomaly_score >= 0.7::DOUBLE THEN 1 END) AS total_alerts
        FROM scored""",
    ),
)
def running_totals_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over the events that the streaming job has stored, as they arrive."""
    events = _run_flow(spark, sf_dir).events(spark).select("id", "anomaly_score")
    channel = work_folder(spark, "scored")
    events.write.parquet(channel)
    arriving = spark.readStream.schema(events.schema).parquet(channel)
    return _landed(spark, running_totals_stream(arriving), "complete", "totals")


@query(
    "features_stream",
    sql(
        "feat",
        "SELECT id, "
        + ", ".join(f"round(CAST({name} AS DOUBLE), 6) AS {name}" for name in FEATURE_NAMES)
        + " FROM feat",
    ),
)
def features_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = work_folder(spark, "features")
    featured = features_stream(_event_stream(spark, sf_dir)).select("id", *FEATURE_NAMES)
    running = (
        featured.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", work_folder(spark, "features-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    _finish(running)
    stored_features = spark.read.schema(featured.schema).parquet(target)
    return stored_features.select(
        "id", *[F.round(F.col(name).cast("double"), 6).alias(name) for name in FEATURE_NAMES]
    )


@query(
    "state_expiry",
    sql("feat", "SELECT id, ip_req_count_1m, ip_req_count_5m, unique_paths_1m FROM feat"),
)
def state_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in four micro-batches, arriving as it happened.

    Between them, state of addresses that were silent for long enough is released; the counts
    are those of the whole table all the same.
    """
    channel, target = work_folder(spark, "log"), work_folder(spark, "features")
    log = source.access_log(spark, sf_dir)
    micros = epoch_micros(F.col("ts"))
    cuts = log.agg(F.percentile_approx(micros, [0.25, 0.5, 0.75])).first()[0]
    part = sum((micros >= cut).cast("int") for cut in cuts)
    for nth in range(len(cuts) + 1):
        log.where(part == nth).write.mode("append").parquet(f"{channel}/part={nth}")
        arriving = (
            spark.readStream.schema(log.schema)
            .parquet(f"{channel}/part=*")
            .withColumn("ingest_ts", F.col("ts"))
        )
        running = (
            features_stream(arriving)
            .select("id", "ip_req_count_1m", "ip_req_count_5m", "unique_paths_1m")
            .writeStream.format("parquet")
            .option("path", target)
            .option("checkpointLocation", f"{target}-checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        _finish(running)
    return spark.read.parquet(target)


_EVENTS_SQL = sql(
    "scored",
    """SELECT id, ts, source_ip, method, path, status_code,
      round(anomaly_score, 6) AS anomaly_score, attack_type FROM scored""",
)
_EVENT_COLUMNS = [
    "id", "ts", "source_ip", "method", "path", "status_code", "anomaly_score", "attack_type",
]
_ALERTS_SQL = sql("alerts", "SELECT id, event_id, severity, alert_type, message FROM alerts")
_ALERT_COLUMNS = ["id", "event_id", "severity", "alert_type", "message"]
_REPUTATION_SQL = sql(
    "reputation",
    """SELECT ip, total_events, total_alerts, round(anomaly_sum, 6) AS anomaly_sum,
      round(reputation_score, 6) AS reputation_score, tag, first_seen, last_seen FROM tagged""",
)


@query(
    "score_log",
    sql(
        "all",
        """SELECT s.id, s.ts, s.source_ip, s.method, s.path, s.status_code,
          round(s.anomaly_score, 6) AS anomaly_score, s.attack_type,
          a.event_id IS NOT NULL AS fired, t.tag
        FROM scored s LEFT JOIN alerts a ON a.event_id = s.id LEFT JOIN tagged t ON t.ip = s.source_ip""",
    ),
)
def score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over the table: every event with its score, whether it fired an alert, and the
    tag of its address."""
    done = process_log(source.access_log(spark, sf_dir), lambda f: hybrid(f, F.col("ml_score")))
    fired = done.alerts.select(F.col("event_id").alias("id"), F.lit(True).alias("fired"))
    tags = done.reputation.select(F.col("ip").alias("source_ip"), "tag")
    events = (
        done.events.select(*_EVENT_COLUMNS).join(fired, "id", "left").join(tags, "source_ip", "left")
        .select(*_EVENT_COLUMNS, F.coalesce("fired", F.lit(False)).alias("fired"), "tag")
    )
    return _rounded(events, "anomaly_score")


@query("events_sink", _EVENTS_SQL)
def events_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = _run_flow(spark, sf_dir)
    return _rounded(flow.events(spark).select(*_EVENT_COLUMNS), "anomaly_score")


@query("alerts_stream", _ALERTS_SQL)
def alerts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_flow(spark, sf_dir).alerts(spark).select(*_ALERT_COLUMNS)


@query(
    "alerts_sink",
    sql(
        "alerts",
        """SELECT severity, alert_type, count(*) AS alerts,
          count(CASE WHEN resolved OR is_false_positive THEN 1 END) AS handled
        FROM alerts GROUP BY severity, alert_type""",
    ),
)
def alerts_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    handled = F.col("resolved") | F.col("is_false_positive")
    return (
        _run_flow(spark, sf_dir)
        .alerts(spark)
        .groupBy("severity", "alert_type")
        .agg(F.count("*").alias("alerts"), F.count_if(handled).alias("handled"))
    )


@query("reputation_sink", _REPUTATION_SQL)
def reputation_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _run_flow(spark, sf_dir).reputation(spark)
    return _rounded(table, "anomaly_sum", "reputation_score")


@query(
    "outbox_stream",
    sql(
        "alerts",
        """SELECT message AS text, severity, source_ip, round(anomaly_score, 6) AS score
        FROM alerts a JOIN scored s ON s.id = a.event_id""",
    ),
)
def outbox_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    outbox = _run_flow(spark, sf_dir).outbox(spark)
    return _rounded(outbox.select("text", "severity", "source_ip", "score"), "score")


@query(
    "late_events",
    sql(
        "feat",
        """SELECT id, source_ip, path, id % 50 = 7 AS held,
          CASE WHEN id % 50 = 7 THEN ip_req_count_1m END AS ip_req_count_1m,
          CASE WHEN id % 50 = 7 THEN ip_fail_count_5m END AS ip_fail_count_5m,
          CASE WHEN id % 50 = 7 THEN unique_paths_1m END AS unique_paths_1m,
          CASE WHEN id % 50 = 7 THEN round(avg_status_code_1m, 6) END AS avg_status_code_1m,
          CASE WHEN id % 50 = 7 THEN burst_rate END AS burst_rate
        FROM feat""",
    ),
)
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows through the streaming job, every fiftieth held back until the others are done.

    The rows held back find all others there, so their counts are those of the whole table.
    """
    flow = Flow(work_folder(spark, "flow"), score=_stand_in)
    log, held = source.access_log(spark, sf_dir), F.col("id") % 50 == 7
    _run_part(spark, flow, log.where(~held))
    _run_part(spark, flow, log.where(held))
    counts = [
        "ip_req_count_1m", "ip_fail_count_5m", "unique_paths_1m", "avg_status_code_1m", "burst_rate",
    ]
    events = flow.events(spark).select(
        "id", "source_ip", "path", held.alias("held"),
        *[F.when(held, F.col(name)).alias(name) for name in counts],
    )
    return _rounded(events, "avg_status_code_1m")


@query(
    "analyst_loop",
    sql(
        "all",
        """SELECT s.id, u.label, r.resolved, r.resolved_by, r.is_false_positive,
          CASE WHEN o.override_ts >= t.last_seen THEN o.tag ELSE t.tag END AS tag
        FROM scored s LEFT JOIN (
          SELECT event_id, max_by(label, labelled_at) AS label FROM (
            SELECT * FROM label_feed WHERE label IN ('normal', 'attack', 'false_positive')
            UNION ALL
            SELECT event_id, 'false_positive', resolved_at FROM resolved_alerts WHERE is_false_positive)
          GROUP BY event_id) u ON u.event_id = s.id
        LEFT JOIN resolved_alerts r ON r.event_id = s.id AND r.resolved
        JOIN tagged t ON t.ip = s.source_ip
        LEFT JOIN (
          SELECT ip, max(override_ts) AS override_ts, max_by(tag, override_ts) AS tag
          FROM overrides WHERE tag <> 'friendly' GROUP BY ip) o ON o.ip = s.source_ip""",
        LABEL_FEED, RESOLUTION_FEED, OVERRIDE_FEED,
    ),
)
def analyst_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, resolutions and tag overrides given to the streaming job's tables, and read back."""
    flow = _run_flow(spark, sf_dir)
    flow.label(_label_feed(spark, sf_dir))
    flow.resolve(_resolution_feed(flow.alerts(spark), source.access_log(spark, sf_dir)))
    flow.override(_override_feed(spark, sf_dir))
    resolved = flow.alerts(spark).select(
        F.col("event_id").alias("id"), "resolved", "resolved_by", "is_false_positive"
    )
    tags = flow.reputation(spark).select(F.col("ip").alias("source_ip"), "tag")
    return (
        flow.events(spark).select("id", "source_ip", "label")
        .join(resolved.where("resolved"), "id", "left").join(tags, "source_ip")
        .select("id", "label", "resolved", "resolved_by", "is_false_positive", "tag")
    )


# --- models --------------------------------------------------------------------------------


def _training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = _featured(spark, sf_dir).select(
        "id", "features", F.lit(None).cast("string").alias("label")
    )
    labelled = label_events(featured, _label_feed(spark, sf_dir))
    return stored(training_rows(labelled).select("id", "features"), "training-rows")


@query("iforest_fit")
def iforest_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the fitted forest."""
    root = work_folder(spark, "forest")
    IsolationForest.fit(_training_table(spark, sf_dir)).save(spark, root, 1)
    return spark.read.parquet(f"{root}/v=1")


@query("iforest_score")
def iforest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _training_table(spark, sf_dir)
    featured = _featured(spark, sf_dir).select("id", "features")
    return IsolationForest.fit(rows).scores(featured).select("id", "iforest_score")


@query("autoencoder_fit")
def autoencoder_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_folder(spark, "autoencoder")
    model = Autoencoder.fit(_training_table(spark, sf_dir))
    model.save(spark, root, 1)
    return spark.read.parquet(f"{root}/v=1")


@query("train_models")
def train_models_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models trained, saved, loaded again and applied to the whole log."""
    root = work_folder(spark, "models")
    train_models(_training_table(spark, sf_dir), root)
    return load_models(spark, root).score(_featured(spark, sf_dir)).select(
        "id", "anomaly_score", "attack_type"
    )


@query(
    "model_store",
    """SELECT 0.0::DOUBLE AS forest_difference, 0.0::DOUBLE AS autoencoder_difference,
      count(*) AS events FROM events""",
)
def model_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest difference between scores of fitted and of reloaded models; all zero."""
    root = work_folder(spark, "models")
    fitted = train_models(_training_table(spark, sf_dir), root)
    loaded = load_models(spark, root)
    vector = F.col("features")
    return _featured(spark, sf_dir).select(
        "id",
        (fitted.forest.decision(vector) - loaded.forest.decision(vector)).alias("forest"),
        (fitted.autoencoder.error(vector) - loaded.autoencoder.error(vector)).alias("autoencoder"),
    ).agg(
        F.max(F.abs("forest")).alias("forest_difference"),
        F.max(F.abs("autoencoder")).alias("autoencoder_difference"),
        F.count("id").alias("events"),
    )


def _splits(value: Column, cut: float, share: float) -> Column:
    """Whether ``cut`` is the interpolated percentile of the values, equal ones included."""
    first = F.floor(F.lit(share) * (F.count(value) - 1)) + 1
    slack = max(abs(cut), 1e-6) * 1e-6  # vectors of equal value may differ by rounding
    return (F.count_if(value < cut - slack) <= first) & (F.count_if(value <= cut + slack) >= first)


@query(
    "model_properties",
    sql(
        "log",
        """SELECT 'v1' AS version, CAST(200 AS BIGINT) AS trees, t.training_rows,
          TRUE AS offset_splits, TRUE AS threshold_splits,
          e.events, e.events AS in_range, 0.0::DOUBLE AS lowest, 1.0::DOUBLE AS highest
        FROM (SELECT count(*) AS training_rows FROM labelled WHERE label IS NULL OR label = 'normal') t,
          (SELECT count(*) AS events FROM access_log) e""",
        LABEL_FEED,
    ),
)
def model_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for the trained models whatever was drawn: number of trees, the share of training
    rows on either side of the forest's offset and of the autoencoder's threshold, every event scored
    once and within bounds, and forest scores that reach both ends."""
    rows, root = _training_table(spark, sf_dir), work_folder(spark, "models")
    train_models(rows, root)
    models, vector = load_models(spark, root), F.col("features")
    trained = rows.select(
        models.forest.decision(vector).alias("decision"),
        models.autoencoder.error(vector).alias("error"),
    ).agg(
        F.count("*").alias("training_rows"),
        _splits(F.col("decision"), 0.0, CONTAMINATION).alias("offset_splits"),
        _splits(F.col("error"), models.autoencoder.threshold, THRESHOLD_PERCENTILE)
        .alias("threshold_splits"),
    )
    featured = stored(_featured(spark, sf_dir), "features")
    forest = models.forest.scores(featured.select("id", "features")).select("id", "iforest_score")
    scored = models.score(featured).select("id", "anomaly_score").join(forest, "id").agg(
        F.count_distinct("id").alias("events"),
        F.count_if(F.col("anomaly_score").between(0, 1)).alias("in_range"),
        F.round(F.min("iforest_score"), 6).alias("lowest"),
        F.round(F.max("iforest_score"), 6).alias("highest"),
    )
    return trained.withColumn("_one", F.lit(1)).join(scored.withColumn("_one", F.lit(1)), "_one").select(
        F.lit(models.name).alias("version"),
        F.lit(len(models.forest.feature)).cast("long").alias("trees"),
        "training_rows", "offset_splits", "threshold_splits", "events", "in_range", "lowest", "highest",
    )


@query(
    "retrain",
    sql(
        "log",
        """SELECT enough AS trained, CAST(CASE WHEN enough THEN nth END AS INTEGER) AS version
        FROM (SELECT count(CASE WHEN label IN ('normal', 'false_positive') THEN 1 END) >= 50
                AS enough FROM labelled), (VALUES (1), (2)) n(nth)""",
        LABEL_FEED,
    ),
)
def retrain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst labels put the gate open; the version in force after each of two retrainings."""
    root = work_folder(spark, "models")
    featured = _featured(spark, sf_dir).withColumn("label", F.lit(None).cast("string"))
    events = stored(
        label_events(featured, _label_feed(spark, sf_dir)).select("id", "features", "label"),
        "events",
    )
    outcomes = [retrain(events, root) for _ in range(2)]
    return spark.createDataFrame(outcomes, "trained boolean, version int")


@query("model_hot_swap")
def model_hot_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores of the whole log before training, and with the models that turn up later."""
    root = work_folder(spark, "models")
    featured = stored(_featured(spark, sf_dir), "features")
    before = load_models(spark, root)
    train_models(_training_table(spark, sf_dir), root)
    after = load_models(spark, root, before)
    parts = [
        models.score(featured, mode="autoencoder")
        .agg(F.avg("anomaly_score").alias("mean_score"))
        .withColumn("version", F.lit(models.name))
        for models in (before, after)
    ]
    return parts[0].unionByName(parts[1])


@query(
    "flow_model_swap",
    sql(
        "log",
        """SELECT CASE WHEN l.id * 2 < m.last THEN 'v0' WHEN g.enough THEN 'v1' ELSE 'v0' END AS version,
          count(*) AS events, CAST(0 AS BIGINT) AS differing
        FROM labelled l, (SELECT max(event_id) AS last FROM events) m,
          (SELECT count(*) >= 50 AS enough FROM labelled, (SELECT max(event_id) AS last FROM events)
           WHERE id * 2 < last AND label IN ('normal', 'false_positive')) g
        GROUP BY 1""",
        LABEL_FEED,
    ),
)
def flow_model_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the first half of the log, without models; labels and training on its own
    events; the job over the second half, with the models it then finds. Per model version, the
    events, and how many scores are not those of a batch job with that version."""
    flow = Flow(work_folder(spark, "flow"), work_folder(spark, "models"))
    log = source.access_log(spark, sf_dir)
    early = F.col("id") * 2 < F.lit(log.agg(F.max("id")).scalar())
    _run_part(spark, flow, log.where(early))
    before = load_models(spark, flow.models_root)
    flow.label(_label_feed(spark, sf_dir))
    flow.retrain(spark)
    _run_part(spark, flow, log.where(~early))
    after = load_models(spark, flow.models_root)
    featured = stored(_featured(spark, sf_dir), "features")
    expected = [
        models.score(featured.where(part), scope="model")
        .select("id", F.col("anomaly_score").alias("expected"), F.lit(models.name).alias("version"))
        for models, part in ((before, early), (after, ~early))
    ]
    found = flow.events(spark).select("id", "anomaly_score")
    same = F.coalesce(F.abs(F.col("anomaly_score") - F.col("expected")) < 1e-9, F.lit(False))
    return (
        expected[0].unionByName(expected[1]).join(found, "id", "left").groupBy("version")
        .agg(F.count("*").alias("events"), F.count_if(~same).alias("differing"))
    )
