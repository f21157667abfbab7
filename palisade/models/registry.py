"""Training both models, storing them by version and picking up new versions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.config import DEFAULTS, Settings
from palisade.functions.scoring import UNFITTED_SCORE
from palisade.models.autoencoder import EPOCHS, Autoencoder, autoencoder_score
from palisade.models.isolation_forest import IsolationForest
from palisade.operators.feedback import (
    MIN_TRAINING_ROWS,
    feedback_count,
    training_rows,
)
from palisade.operators.scoring import score_events
from palisade.session import stored
from palisade.sources.tables import latest_version


def _forest_root(root: str) -> str:
    return f"{root}/isolation_forest"


def _autoencoder_root(root: str) -> str:
    return f"{root}/autoencoder"


@dataclass(frozen=True)
class Models:
    """The models of one version; a missing model is not fitted and scores 0.5."""

    version: int | None = None
    forest: IsolationForest | None = None
    autoencoder: Autoencoder | None = None

    @property
    def name(self) -> str:
        return f"v{self.version or 0}"

    def with_scores(self, featured: DataFrame, scope: str = "batch") -> DataFrame:
        """Adds ``iforest_score`` and ``ae_score``."""
        if self.forest is None:
            scored = featured.withColumn("iforest_score", F.lit(UNFITTED_SCORE))
        else:
            scored = self.forest.scores(featured, scope)
        return scored.withColumn("ae_score", autoencoder_score(self.autoencoder, F.col("features")))

    def score(
        self,
        featured: DataFrame,
        mode: str = "hybrid",
        scope: str = "batch",
        settings: Settings = DEFAULTS,
    ) -> DataFrame:
        scored = self.with_scores(featured, scope)
        return score_events(
            scored, mode, F.col("iforest_score"), F.col("ae_score"), settings
        ).drop("iforest_score", "ae_score")


def newest_version(spark: SparkSession, root: str) -> int | None:
    """Latest version for which both models are complete."""
    versions = [
        latest_version(spark, _forest_root(root)), latest_version(spark, _autoencoder_root(root))
    ]
    return None if None in versions else min(versions)


def load_models(spark: SparkSession, root: str, current: Models | None = None) -> Models:
    """The newest models; ``current`` is returned as it is when nothing newer is there."""
    version = newest_version(spark, root)
    if current is not None and current.version == version:
        return current
    if version is None:
        return Models()
    return Models(
        version,
        IsolationForest.load(spark, _forest_root(root), version),
        Autoencoder.load(spark, _autoencoder_root(root), version),
    )


def train_models(rows: DataFrame, root: str, epochs: int = EPOCHS) -> Models:
    """Fits both models on stored ``rows`` (id, features) and saves them as the next version."""
    spark = rows.sparkSession
    version = (newest_version(spark, root) or 0) + 1
    forest = IsolationForest.fit(rows)
    autoencoder = Autoencoder.fit(rows, epochs)
    forest.save(spark, _forest_root(root), version)
    autoencoder.save(spark, _autoencoder_root(root), version)
    return Models(version, forest, autoencoder)


def retrain(events: DataFrame, root: str, epochs: int = EPOCHS) -> tuple[bool, int | None]:
    """Trains on stored features when there are enough analyst labels and rows.

    Returns whether it trained, and the version in force. A running stream picks the new version
    up with its next micro-batch.
    """
    spark = events.sparkSession
    if not feedback_count(events).first()["enough"]:
        return False, newest_version(spark, root)
    rows = stored(training_rows(events).select("id", "features"), "training-rows")
    if rows.count() < MIN_TRAINING_ROWS:
        return False, newest_version(spark, root)
    return True, train_models(rows, root, epochs).version
