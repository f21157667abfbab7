"""The streaming job: messages to stored events, alerts, reputation and live payloads.

Everything after the stateful features is ordinary DataFrame code inside one ``foreachBatch``,
the same operators batch jobs use. All outputs of micro-batch ``n`` go to folders named after it
and are overwritten as a whole, and state from before is read as of ``n - 1``, so a retried
micro-batch changes nothing.

Analysts add labels, resolutions and tag overrides at any time, to tables of their own. The readers
apply them, so a running job and its stored batches are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from palisade.config import DEFAULTS, Settings
from palisade.models.autoencoder import EPOCHS
from palisade.models.registry import Models, load_models, retrain
from palisade.operators import alerts as alert_ops
from palisade.operators import reputation as reputation_ops
from palisade.operators import tables as table_ops
from palisade.operators.features import FIVE_MINUTES, with_features
from palisade.operators.parse import accepted, parse_log, quarantined
from palisade.schemas import (
    ALERT_SCHEMA,
    COOLDOWN_SCHEMA,
    FEATURE_NAMES,
    REPUTATION_SCHEMA,
)
from palisade.sources import tables
from palisade.sources.capture import alert_outbox, live_feed
from palisade.streaming.features import ALLOWED_LATENESS, features_stream

STRETCH_SCHEMA = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("events", T.LongType()),
        T.StructField("alerts", T.LongType()),
        T.StructField("anomaly_sum", T.DoubleType()),
        T.StructField("weighted", T.DoubleType()),
        T.StructField("first_contribution", T.DoubleType()),
        T.StructField("first_seen", T.TimestampNTZType()),
        T.StructField("last_seen", T.TimestampNTZType()),
    ]
)

_RESOLUTION_SCHEMA = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("resolved_by", T.StringType()),
        T.StructField("resolved_at", T.TimestampNTZType()),
        T.StructField("is_false_positive", T.BooleanType()),
    ]
)

_OVERRIDE_SCHEMA = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("override_ts", T.TimestampNTZType()),
    ]
)

_EVENT_COLUMNS = [
    "id", "ts", "source_ip", "dest_ip", "method", "path", "status_code", "user_agent",
    "log_source", "raw_log", *FEATURE_NAMES, "features", "anomaly_score", "attack_type",
]

Scorer = Callable[[DataFrame, Models], DataFrame]


def identified(log: DataFrame) -> DataFrame:
    """Gives messages without an id one that a retry reproduces."""
    if "id" in log.columns:
        return log
    return log.withColumn(
        "id", F.sha2(F.concat_ws("\n", F.col("ingest_ts").cast("string"), "value"), 256)
    )


def log_stream(messages: DataFrame, **options: bool) -> DataFrame:
    """Accepted log rows of a stream of (value, ingest_ts) messages."""
    return identified(accepted(parse_log(messages, **options))).drop("value")


def score_with_models(featured: DataFrame, models: Models) -> DataFrame:
    """Scores by the range the model saw in training, whatever else is in the micro-batch."""
    return models.score(featured, scope="model")


@dataclass
class Flow:
    """Where the job keeps its tables, and how it scores.

    ``score`` adds ``anomaly_score`` and ``attack_type`` to featured rows; by default the newest
    stored models do, looked up again at every micro-batch.
    """

    root: str
    models_root: str | None = None
    score: Scorer = score_with_models
    settings: Settings = DEFAULTS
    compact_every: int = 50
    keep_snapshots: int = 5
    _models: Models = field(default_factory=Models, repr=False)

    def table(self, name: str) -> str:
        return f"{self.root}/{name}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """Handles one micro-batch of featured log rows."""
        spark = batch.sparkSession
        if self.models_root:
            self._models = load_models(spark, self.models_root, self._models)
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if batch.isEmpty():
                return
            schema = self._store_events(batch, batch_id)
        finally:
            batch.unpersist()
        events = tables.read_batch(spark, self.table("events"), schema, batch_id)
        self._store_alerts(events, batch_id)
        self._store_reputation(events, batch_id)
        live_feed(events).select("payload").write.mode("overwrite").text(
            f"{self.table('live_feed')}/batch_id={batch_id}"
        )
        if batch_id and batch_id % self.compact_every == 0:
            self._tidy(spark, batch_id)

    def _store_events(self, batch: DataFrame, batch_id: int) -> T.StructType:
        own_id = F.when(F.col("copy") == 0, F.col("id"))
        if isinstance(batch.schema["id"].dataType, T.StringType):
            own_id = own_id.otherwise(F.concat_ws("-", "id", F.col("copy").cast("string")))
        else:
            own_id = own_id.otherwise(F.xxhash64("id", "copy", "ingest_ts"))
        named = batch.withColumn("id", own_id).drop("copy")
        late = named.where("late").drop("late").withColumn("reject_reason", F.lit("late"))
        tables.write_batch(late, self.table("late"), batch_id)
        in_time = named.where(~F.col("late")).drop("late")
        late = tables.read_batch(batch.sparkSession, self.table("late"), late.schema, batch_id)
        if not late.isEmpty():
            found = self._late_features(late.drop("reject_reason"), in_time, batch_id)
            in_time = in_time.unionByName(found)
        events = self.score(in_time, self._models).select(
            *_EVENT_COLUMNS,
            F.lit(None).cast("string").alias("label"),
            F.col("ingest_ts").alias("created_at"),
        )
        tables.write_batch(events, self.table("events"), batch_id, date_of="ts")
        return events.schema

    def _late_features(self, late: DataFrame, in_time: DataFrame, batch_id: int) -> DataFrame:
        """Late rows with the counts their frames hold by now, most of which the stream's state has
        let go: from the stored events of their addresses, on the days concerned, and this batch.

        Events that follow a late one and have their scores already keep them.
        """
        spark = late.sparkSession
        counts = [*FEATURE_NAMES, "features"]
        plain = late.drop(*counts)
        needed = ["id", "ts", "source_ip", "method", "path", "status_code"]
        days = late.agg(
            F.to_date(F.min("ts") - F.expr(f"INTERVAL {FIVE_MINUTES} SECONDS")).alias("first"),
            F.to_date(F.max("ts")).alias("last"),
        ).first()
        before = tables.read_complete(
            spark, self.table("events"), T.StructType(
                [*(late.schema[name] for name in needed), T.StructField("day", T.DateType())]
            ), last=batch_id - 1,
        ).where(F.col("day").between(days["first"], days["last"]))
        around = before.select(*needed).unionByName(in_time.select(*needed))
        around = around.join(late.select("source_ip").distinct(), "source_ip", "left_semi")
        together = plain.withColumn("_late", F.lit(True)).unionByName(
            around, allowMissingColumns=True
        )
        return with_features(together).where("_late").select(*in_time.columns)

    def _store_alerts(self, events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        candidates = alert_ops.alert_candidates(events, self.settings)
        earliest = candidates.agg(F.min("ts").cast("string").alias("ts")).first()["ts"]
        # A fire longer ago than the pause before the first candidate silences none of them.
        pause = F.expr(f"INTERVAL {self.settings.cooldown_seconds} SECONDS")
        last_fires = self.last_fires(spark, batch_id - 1).where(
            F.col("last_fire") > F.lit(earliest).cast("timestamp_ntz") - pause
        )
        fired = alert_ops.fired_events(
            events, last_fires, created_at="created_at", settings=self.settings, in_storage=True
        )
        tables.write_batch(alert_ops.alert_rows(fired, "created_at"), self.table("alerts"), batch_id)
        rows = tables.read_batch(spark, self.table("alerts"), self.alert_schema(events), batch_id)
        again = candidates.join(rows.select(F.col("event_id").alias("id")), "id", "left_semi")
        tables.write_batch(alert_ops.latest_fires(again), self.table("fires"), batch_id)
        tables.write_batch(alert_outbox(rows, events), self.table("alert_outbox"), batch_id)

    def last_fires(self, spark: SparkSession, last: int) -> DataFrame:
        """Latest alert time per (address, type) after micro-batch ``last``.

        Each micro-batch adds what it fired; now and then all is folded into a snapshot.
        """
        version = tables.latest_version(spark, self.table("cooldown"), before=last + 1)
        known = tables.read_snapshot(spark, self.table("cooldown"), COOLDOWN_SCHEMA, version)
        fires = tables.read_batches(
            spark, self.table("fires"), COOLDOWN_SCHEMA, -1 if version is None else version, last
        )
        return alert_ops.latest_fires(fires, known, ts="last_fire")

    def _tidy(self, spark: SparkSession, batch_id: int) -> None:
        """Compacts what is stored up to the micro-batch before this one."""
        done = batch_id - 1
        # In order of time, so that a micro-batch reads the latest part only.
        fires = self.last_fires(spark, done).repartitionByRange("last_fire")
        tables.write_snapshot(
            fires.sortWithinPartitions("last_fire"), self.table("cooldown"), done
        )
        oldest = tables.prune_snapshots(spark, self.table("cooldown"), self.keep_snapshots)
        tables.remove_batches(spark, self.table("fires"), oldest)
        for name, order in (("events", "id"), ("alerts", "event_id"), ("alert_outbox", "timestamp")):
            tables.compact(spark, self.table(name), done, order)

    def _store_reputation(self, events: DataFrame, batch_id: int) -> None:
        """Appends the batch's stretches; now and then they are folded into a snapshot."""
        stretches = reputation_ops.summarise_events(events, settings=self.settings)
        tables.write_batch(stretches, self.table("stretches"), batch_id)
        if batch_id and batch_id % self.compact_every == 0:
            table = self._reputation(events.sparkSession, last=batch_id)
            tables.write_snapshot(table, self.table("reputation"), batch_id)
            oldest = tables.prune_snapshots(
                events.sparkSession, self.table("reputation"), self.keep_snapshots
            )
            tables.remove_batches(events.sparkSession, self.table("stretches"), oldest)

    # --- reading the tables ----------------------------------------------------------------

    @staticmethod
    def alert_schema(events: DataFrame) -> T.StructType:
        kind = events.schema["id"].dataType
        return T.StructType(
            [
                T.StructField(f.name, kind) if f.name == "event_id" else f
                for f in ALERT_SCHEMA.fields
            ]
        )

    def events(self, spark: SparkSession) -> DataFrame:
        """All events, with their newest label.

        An alert resolved as a false positive labels its event as one, at the time of the resolution.
        """
        stored = tables.read_complete(spark, self.table("events"))
        labels = self._updates(spark, "labels", self._label_schema(stored))
        wrong = (
            self._resolutions(spark)
            .where(F.coalesce("is_false_positive", F.lit(False)))
            .join(self._stored_alerts(spark).select(F.col("id").alias("alert_id"), "event_id"), "alert_id")
            .select(
                "event_id", F.lit("false_positive").alias("label"),
                F.col("resolved_at").alias("labelled_at"),
            )
        )
        return table_ops.label_events(stored, labels.unionByName(wrong))

    def late(self, spark: SparkSession) -> DataFrame:
        """Rows that came too late for the stream's counts, as they came; events has them as well."""
        return tables.read_complete(spark, self.table("late"))

    def _stored_alerts(self, spark: SparkSession) -> DataFrame:
        return tables.read_complete(spark, self.table("alerts"))

    def alerts(self, spark: SparkSession) -> DataFrame:
        """All alerts, with their newest resolution."""
        return table_ops.resolve_alerts(self._stored_alerts(spark), self._resolutions(spark))

    def outbox(self, spark: SparkSession) -> DataFrame:
        """Notifications for every alert that fired."""
        return tables.read_complete(spark, self.table("alert_outbox"))

    def reputation(self, spark: SparkSession) -> DataFrame:
        """Reputation after all micro-batches, with the tag overrides that still hold."""
        overrides = self._updates(spark, "overrides", _OVERRIDE_SCHEMA)
        return reputation_ops.override_tags(self._reputation(spark), overrides)

    def _reputation(self, spark: SparkSession, last: int | None = None) -> DataFrame:
        """Reputation after all, or the first ``last``, micro-batches."""
        root = self.table("reputation")
        version = tables.latest_version(spark, root, before=last)
        known = tables.read_snapshot(spark, root, REPUTATION_SCHEMA, version)
        after = -1 if version is None else version
        stretches = tables.read_batches(
            spark, self.table("stretches"), STRETCH_SCHEMA, after=after, last=last
        )
        combined = reputation_ops.combine_stretches(stretches, "batch_id", self.settings)
        return reputation_ops.merge_reputation(known, combined, self.settings)

    # --- what analysts do -------------------------------------------------------------------

    def _updates(self, spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
        return tables.read_complete(spark, self.table(name), schema).select(*schema.names)

    def _resolutions(self, spark: SparkSession) -> DataFrame:
        return self._updates(spark, "resolutions", _RESOLUTION_SCHEMA)

    @staticmethod
    def _label_schema(events: DataFrame) -> T.StructType:
        return T.StructType(
            [
                T.StructField("event_id", events.schema["id"].dataType),
                T.StructField("label", T.StringType()),
                T.StructField("labelled_at", T.TimestampNTZType()),
            ]
        )

    def label(self, updates: DataFrame) -> None:
        """Adds labels (event_id, label, labelled_at); only known labels of known events count."""
        tables.append_updates(
            updates.select("event_id", "label", "labelled_at"), self.table("labels")
        )

    def resolve(self, updates: DataFrame) -> None:
        """Adds resolutions (alert_id, resolved_by, resolved_at, is_false_positive)."""
        tables.append_updates(
            updates.select(*_RESOLUTION_SCHEMA.names), self.table("resolutions")
        )

    def override(self, updates: DataFrame) -> None:
        """Adds tag overrides (ip, tag, override_ts), each valid until the address's next event."""
        tables.append_updates(updates.select(*_OVERRIDE_SCHEMA.names), self.table("overrides"))

    def retrain(self, spark: SparkSession, epochs: int = EPOCHS) -> tuple[bool, int | None]:
        """Trains on the job's own labelled events; the next micro-batch scores with the result."""
        if not self.models_root:
            raise ValueError("the job has no folder for models")
        return retrain(self.events(spark), self.models_root, epochs)

    # --- starting --------------------------------------------------------------------------

    def start(
        self,
        log: DataFrame,
        checkpoint: str,
        available_now: bool = False,
        interval: str = "10 seconds",
        lateness: int = ALLOWED_LATENESS,
    ) -> StreamingQuery:
        """Starts the job on a stream of log rows."""
        full = log.withColumns(
            {
                name: F.lit(None).cast("string")
                for name in ("dest_ip", "user_agent", "log_source", "raw_log")
                if name not in log.columns
            }
        )
        writer = (
            features_stream(full, lateness=lateness)
            .writeStream.foreachBatch(self)
            .option("checkpointLocation", checkpoint)
        )
        trigger = {"availableNow": True} if available_now else {"processingTime": interval}
        return writer.trigger(**trigger).start()

    def start_quarantine(
        self, messages: DataFrame, checkpoint: str, available_now: bool = False
    ) -> StreamingQuery:
        """Starts the side stream of rejected messages."""
        rejected = quarantined(parse_log(messages))

        def store(batch: DataFrame, batch_id: int) -> None:
            tables.write_batch(batch, self.table("quarantine"), batch_id)

        trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
        return (
            rejected.writeStream.foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )
