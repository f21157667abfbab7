"""Autoencoder trained data-parallel on Spark, with a result that the layout of the rows can't change.

Equal vectors are counted first. The counts are dealt out to buckets of some ``ROWS_PER_BUCKET`` rows by
a hash of their content, and a bucket is packed to one row, so that an epoch moves no rows: neither the number of partitions nor the order of rows nor a retried task
plays a part, and a vector with a third of all rows spreads over many buckets. Each epoch every bucket
runs Adam over its rows in mini-batches, in an order drawn from (seed, epoch, bucket), starting from the
common state. The states are averaged, weighted by rows, in groups of ``FOLD`` successive buckets, level
by level, so sums are always taken in the same order and the driver receives one state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.scoring import UNFITTED_SCORE, error_score
from palisade.operators.quantiles import percentile
from palisade.session import stored
from palisade.sources.tables import latest_version, read_snapshot, write_snapshot

# Fixed values.
LAYERS = [12, 32, 16, 8, 16, 32, 12]
DROPOUT = 0.1
DROPOUT_AFTER = [0, 4]  # layers followed by dropout while training
EPOCHS = 50
BATCH_SIZE = 256
LEARNING_RATE = 1e-3
THRESHOLD_PERCENTILE = 0.95
DEFAULT_THRESHOLD = 0.1
ADAM = (0.9, 0.999, 1e-8)

#: Rows that one task trains on in sequence; the number of buckets follows the number of rows.
ROWS_PER_BUCKET = 16_384
#: Copies of one vector that stay together, and how many such pieces are cut off at once.
PIECE, PIECES_AT_ONCE = 256, 1024
#: Buckets that a task holds at most when there are many, about a megabyte each.
BUCKETS_PER_TASK = 32
#: States averaged by one task.
FOLD = 32

_SHAPES = [(a, b) for a, b in zip(LAYERS[:-1], LAYERS[1:])]
WEIGHTS = sum(a * b + b for a, b in _SHAPES)
MODEL_SCHEMA = "position int, weight double, shift double, scale double, threshold double"


def error_threshold(rows: DataFrame, error: Column | str) -> float | None:
    """95th percentile of the errors, interpolated."""
    return percentile(rows, error, THRESHOLD_PERCENTILE)


def _layers(weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the flat weights as (matrix, bias) per layer."""
    views, start = [], 0
    for inputs, outputs in _SHAPES:
        matrix = weights[start : start + inputs * outputs].reshape(inputs, outputs)
        start += inputs * outputs
        views.append((matrix, weights[start : start + outputs]))
        start += outputs
    return views


def initial_weights(seed: int) -> np.ndarray:
    random = np.random.default_rng(seed)
    weights = np.empty(WEIGHTS)
    for matrix, bias in _layers(weights):
        bound = 1.0 / np.sqrt(len(matrix))
        matrix[:] = random.uniform(-bound, bound, matrix.shape)
        bias[:] = random.uniform(-bound, bound, bias.shape)
    return weights


def reconstruct(weights: np.ndarray, points: np.ndarray) -> np.ndarray:
    value = points
    for nth, (matrix, bias) in enumerate(_layers(weights)):
        value = value @ matrix + bias
        if nth < len(_SHAPES) - 1:
            value = np.maximum(value, 0.0)
    return value


def _gradient(weights: np.ndarray, points: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Gradient of the mean squared reconstruction error, with dropout."""
    gradient = np.empty_like(weights)
    _into(_layers(gradient), _layers(weights), points, random)
    return gradient


def _into(gradient: list, layers: list, points: np.ndarray, random: np.random.Generator) -> None:
    """Writes the gradient to the views ``gradient``, laid out as ``layers``."""
    inputs, gates, value = [], [], points
    for nth, (matrix, bias) in enumerate(layers):
        inputs.append(value)
        value = value @ matrix
        value += bias
        if nth < len(layers) - 1:
            gate = (value > 0).astype(float)
            if nth in DROPOUT_AFTER:
                gate *= (random.random(value.shape) >= DROPOUT) / (1.0 - DROPOUT)
            value *= gate
            gates.append(gate)
    back = value
    back -= points
    back *= 2.0
    back /= points.size
    for nth in range(len(layers) - 1, -1, -1):
        matrix, bias = gradient[nth]
        np.matmul(inputs[nth].T, back, out=matrix)
        np.add.reduce(back, axis=0, out=bias)
        if nth:
            back = back @ layers[nth][0].T
            back *= gates[nth - 1]


def _as_points(vectors: pd.Series, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (np.stack(vectors.to_numpy()).astype(np.float64) - shift) / scale


def _cut(rows: DataFrame, size: int, nth: str) -> DataFrame:
    """Cuts ``copies`` into parts of at most ``size``, numbered by ``nth``."""
    parts = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {size}"))
    return rows.select("*", F.explode(parts).alias(nth)).withColumn(
        "copies", F.least(F.col("copies") - F.col(nth) * size, F.lit(size))
    )


def _dealt(counted: DataFrame, buckets: int, seed: int) -> DataFrame:
    """(features, copies, bucket) of distinct vectors with their number of ``copies``."""
    pieces = _cut(_cut(counted, PIECE * PIECES_AT_ONCE, "_wide"), PIECE, "_nth")
    place = F.xxhash64("features", "_wide", "_nth", F.lit(seed))
    return pieces.select("features", "copies", F.pmod(place, F.lit(buckets)).alias("bucket"))


def _moments(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation by component; decimal sums don't depend on their order."""
    value = [F.col("features")[nth].cast("decimal(19, 9)") for nth in range(LAYERS[0])]
    found = counted.agg(
        F.sum("copies").alias("rows"),
        F.array(*[F.sum(x * F.col("copies")) for x in value]).alias("sums"),
        F.array(*[F.sum((x * x).cast("decimal(28, 9)") * F.col("copies")) for x in value]).alias("squares"),
    ).first()
    mean = [total / found["rows"] for total in found["sums"]]
    spread = [max(total / found["rows"] - m * m, 0) for total, m in zip(found["squares"], mean)]
    return np.array(mean, dtype=float), np.sqrt(np.array(spread, dtype=float))


_STATE = "bucket bigint, rows bigint, state array<double>"
_BUCKET = "bucket bigint, kind string, vectors binary, copies binary"


def _packed(key: tuple, bucket: pd.DataFrame) -> pd.DataFrame:
    """A bucket as one row: its vectors in the order of their components, and their copies."""
    vectors, copies = np.stack(bucket["features"].to_numpy()), bucket["copies"].to_numpy(np.int64)
    order = np.lexsort([copies, *vectors.T])
    return pd.DataFrame({
        "bucket": [key[0]], "kind": [vectors.dtype.str],
        "vectors": [vectors[order].tobytes()], "copies": [copies[order].tobytes()],
    })


def _buckets(dealt: DataFrame, buckets: int) -> DataFrame:
    """One packed row per bucket, in as many partitions as keep all cores at work on a few of them each."""
    cores = dealt.sparkSession.sparkContext.defaultParallelism
    parts = min(buckets, max(2 * cores, math.ceil(buckets / BUCKETS_PER_TASK)))
    return dealt.groupBy("bucket").applyInPandas(_packed, _BUCKET).repartition(parts, "bucket")


def _train_epoch(
    state: np.ndarray, shift: np.ndarray, scale: np.ndarray, seed: int, epoch: int,
    batch_size: int, rate: float,
):
    decay_first, decay_second, epsilon = ADAM

    def train(number: int, points: np.ndarray) -> np.ndarray:
        random = np.random.default_rng([seed, epoch, number])
        weights, first, second = (part.copy() for part in np.split(state[:-1], 3))
        step = state[-1]
        points = points[random.permutation(len(points))]
        gradient, moved, spread = (np.empty_like(weights) for _ in range(3))
        layers, slopes = _layers(weights), _layers(gradient)
        for start in range(0, len(points), batch_size):
            _into(slopes, layers, points[start : start + batch_size], random)
            step += 1
            np.multiply(gradient, gradient, out=moved)
            moved *= 1 - decay_second
            second *= decay_second
            second += moved
            gradient *= 1 - decay_first
            first *= decay_first
            first += gradient
            np.divide(second, 1 - decay_second**step, out=spread)
            np.sqrt(spread, out=spread)
            spread += epsilon
            np.divide(first, 1 - decay_first**step, out=moved)
            moved *= rate
            moved /= spread
            weights -= moved
        return np.concatenate([weights, first, second, [step]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bucket in batch.itertuples():
                vectors = np.frombuffer(bucket.vectors, bucket.kind).reshape(-1, LAYERS[0])
                points = (vectors.astype(np.float64) - shift) / scale
                points = np.repeat(points, np.frombuffer(bucket.copies, np.int64), axis=0)
                ended = train(int(bucket.bucket), points)
                yield pd.DataFrame({"bucket": [bucket.bucket], "rows": [len(points)], "state": [ended]})

    return run


def _mean_state(key: tuple, states: pd.DataFrame) -> pd.DataFrame:
    states = states.sort_values("bucket")
    mean = np.average(np.stack(states["state"].to_numpy()), axis=0, weights=states["rows"])
    return pd.DataFrame({"bucket": [key[0]], "rows": [states["rows"].sum()], "state": [mean]})


def _averaged(states: DataFrame, buckets: int) -> np.ndarray:
    """The mean of one state per bucket, folded level by level in the order of the buckets."""
    while buckets > 1:
        group = F.expr(f"bucket div {FOLD}").alias("group")
        states = states.groupBy(group).applyInPandas(_mean_state, _STATE)
        buckets = math.ceil(buckets / FOLD)
    return np.array(states.collect()[0]["state"])  # one row


@dataclass(frozen=True)
class Autoencoder:
    weights: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    threshold: float = DEFAULT_THRESHOLD

    @classmethod
    def fit(
        cls,
        rows: DataFrame,
        epochs: int = EPOCHS,
        batch_size: int = BATCH_SIZE,
        rate: float = LEARNING_RATE,
        seed: int = 42,
        standardize: bool = False,
    ) -> Autoencoder:
        """Fits on ``rows`` (features), a stored table. Rows without features don't count."""
        features = rows.select("features").where("features IS NOT NULL")
        counted = stored(features.groupBy("features").agg(F.count("*").alias("copies")), "vectors")
        total = counted.agg(F.sum("copies").alias("rows")).first()["rows"]
        if not total:
            raise ValueError("no training rows")
        shift, scale = np.zeros(LAYERS[0]), np.ones(LAYERS[0])
        if standardize:
            shift, deviation = _moments(counted)
            scale = np.where(deviation > 0, deviation, 1.0)
        buckets = math.ceil(total / ROWS_PER_BUCKET)
        dealt = _buckets(_dealt(counted, buckets, seed), buckets).persist(StorageLevel.MEMORY_AND_DISK)
        state = np.concatenate([initial_weights(seed), np.zeros(2 * WEIGHTS), [0.0]])
        try:
            for epoch in range(epochs):
                train = _train_epoch(state, shift, scale, seed, epoch, batch_size, rate)
                state = _averaged(dealt.mapInPandas(train, _STATE), buckets)
        finally:
            dealt.unpersist()
        fitted = cls(state[:WEIGHTS], shift, scale)
        errors = stored(features.select(fitted.error(F.col("features")).alias("error")), "errors")
        threshold = error_threshold(errors, "error")
        return cls(fitted.weights, shift, scale, float(threshold))

    def error(self, features: Column) -> Column:
        """Mean squared reconstruction error per feature array."""
        model = self

        @F.pandas_udf("double")
        def squared_error(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype="float64")
            points = _as_points(vectors, model.shift, model.scale)
            return pd.Series(((reconstruct(model.weights, points) - points) ** 2).mean(axis=1))

        return squared_error(features)

    def score(self, features: Column) -> Column:
        return error_score(self.error(features), F.lit(self.threshold))

    def save(self, spark: SparkSession, root: str, version: int) -> None:
        padding = [np.nan] * (WEIGHTS - LAYERS[0])
        frame = pd.DataFrame(
            {
                "position": np.arange(WEIGHTS, dtype="int32"),
                "weight": self.weights,
                "shift": [*self.shift, *padding],
                "scale": [*self.scale, *padding],
                "threshold": self.threshold,
            }
        )
        write_snapshot(spark.createDataFrame(frame, MODEL_SCHEMA).coalesce(1), root, version)

    @classmethod
    def load(cls, spark: SparkSession, root: str, version: int | None = None) -> Autoencoder | None:
        """The given or latest saved version; None when there is none."""
        version = latest_version(spark, root) if version is None else version
        if version is None:
            return None
        schema = spark.createDataFrame([], MODEL_SCHEMA).schema
        table = read_snapshot(spark, root, schema, version).toPandas().sort_values("position")
        inputs = slice(0, LAYERS[0])
        return cls(
            table["weight"].to_numpy(),
            table["shift"].to_numpy()[inputs],
            table["scale"].to_numpy()[inputs],
            float(table["threshold"].iloc[0]),
        )


def autoencoder_score(model: Autoencoder | None, features: Column) -> Column:
    return F.lit(UNFITTED_SCORE) if model is None else model.score(features)
