"""Isolation forest (Liu, Ting and Zhou, 2008) trained and applied on Spark.

Trees are built in parallel, one group per tree, from a uniform sample of at most 256 rows each.
The model is a table of nodes whose size depends on the settings only, not on the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions.scoring import inverted_minmax
from palisade.operators.quantiles import percentile
from palisade.operators.scoring import minmax_scores
from palisade.session import stored
from palisade.sources.tables import latest_version, read_snapshot, write_snapshot

# Fixed values.
TREES = 200
SAMPLE_SIZE = 256
CONTAMINATION = 0.05
SEED = 42
EULER = 0.5772156649015329

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left_child int, right_child int, "
    "path_length double"
)
MODEL_SCHEMA = f"{NODE_SCHEMA}, sample_size int, offset double, low double, high double"
_UNIT = float(2**53)
#: Rows that walk the trees together; what a step makes for them stays in a core's cache.
WALKED = 256


def _hash_fraction(*parts: Column) -> Column:
    """Repeatable pseudo-random number in [0, 1), so that retried tasks draw the same sample."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(2**53 - 1)) / F.lit(_UNIT)


def average_path(size: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``size`` leaves."""
    if size <= 1:
        return 0.0
    if size == 2:
        return 1.0
    return 2.0 * (math.log(size - 1.0) + EULER) - 2.0 * (size - 1.0) / size


def tree_samples(
    rows: DataFrame, total: int, trees: int = TREES, size: int = SAMPLE_SIZE, seed: int = SEED
) -> DataFrame:
    """(tree, features): for each tree ``size`` rows without replacement.

    Each tree takes the rows with its lowest hashes, out of all rows. About four times as many come
    into question; only those are sorted.
    """
    share = min(1.0, 4.0 * size / total)

    def draw(tree: Column) -> Column:
        return _hash_fraction(F.lit(seed), tree, F.col("id"))

    # Repeated for all trees and filtered in one compiled stage; a lambda over an array is interpreted.
    every = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    drawn = rows.select("id", "features", every).where(draw(F.col("tree")) < share)
    lowest = Window.partitionBy("tree").orderBy("_draw", "id")
    return (
        drawn.withColumn("_draw", draw(F.col("tree")))
        .withColumn("_nth", F.row_number().over(lowest))
        .where(F.col("_nth") <= size)
        .select("tree", "features")
    )


def _grow(size: int, seed: int):
    height = max(1, math.ceil(math.log2(max(size, 2))))

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        points = np.stack(sample["features"].to_numpy()).astype(np.float64)
        points = points[np.lexsort(points.T)]  # the rows arrive in no particular order
        random = np.random.default_rng([seed, tree])
        nodes: list[list] = []
        pending = [(np.arange(len(points)), 0, -1, 0)]
        while pending:
            members, depth, parent, side = pending.pop()
            node = len(nodes)
            if parent >= 0:
                nodes[parent][side] = node
            here = points[members]
            low, high = here.min(axis=0), here.max(axis=0)
            varying = np.flatnonzero(high > low)
            if depth >= height or not len(varying):
                path = depth + average_path(len(members))
                nodes.append([tree, node, -1, 0.0, node, node, path])
                continue
            feature = int(random.choice(varying))
            threshold = float(random.uniform(low[feature], high[feature]))
            goes_left = here[:, feature] <= threshold
            nodes.append([tree, node, feature, threshold, -1, -1, 0.0])
            pending.append((members[~goes_left], depth + 1, node, 5))
            pending.append((members[goes_left], depth + 1, node, 4))
        return pd.DataFrame(nodes, columns=[field.split()[0] for field in NODE_SCHEMA.split(", ")])

    return run


@dataclass(frozen=True)
class IsolationForest:
    """A fitted forest: node columns as (trees, nodes) arrays, the decision offset, and the lowest and
    highest decision value of a training row."""

    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray
    path_length: np.ndarray
    sample_size: int
    offset: float
    low: float = 0.0
    high: float = 0.0

    @classmethod
    def fit(
        cls,
        rows: DataFrame,
        trees: int = TREES,
        contamination: float = CONTAMINATION,
        seed: int = SEED,
    ) -> IsolationForest:
        """Fits on ``rows`` (id, features), a stored table: it is read three times."""
        total = rows.count()
        if not total:
            raise ValueError("no training rows")
        size = min(SAMPLE_SIZE, total)
        nodes = (
            tree_samples(rows, total, trees, size, seed)
            .groupBy("tree")
            .applyInPandas(_grow(size, seed), NODE_SCHEMA)
            .toPandas()  # at most trees * (2 * 256 - 1) short rows
        )
        forest = cls._from_nodes(nodes, size, 0.0)
        scored = stored(rows.select(forest.decision(F.col("features")).alias("score")), "scores")
        offset = percentile(scored, "score", contamination)
        low, high = scored.agg(F.min("score"), F.max("score")).first()
        return cls._from_nodes(nodes, size, offset, low - offset, high - offset)

    @classmethod
    def _from_nodes(
        cls, nodes: pd.DataFrame, size: int, offset: float, low: float = 0.0, high: float = 0.0
    ) -> IsolationForest:
        shape = (int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1)
        at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())

        def grid(name: str, fill, kind) -> np.ndarray:
            cells = np.full(shape, fill, dtype=kind)
            cells[at] = nodes[name].to_numpy()
            return cells

        children = np.stack([grid("right_child", 0, np.int64), grid("left_child", 0, np.int64)])
        return cls(
            grid("feature", -1, np.int64),
            grid("threshold", 0.0, np.float64),
            children,
            grid("path_length", 0.0, np.float64),
            size,
            offset,
            low,
            high,
        )

    def raw_scores(self, points: np.ndarray) -> np.ndarray:
        """Minus the anomaly score of the paper, for an (n, features) array.

        All trees are walked at once, level by level; a leaf leads to itself.
        """
        trees, width = self.feature.shape
        root = np.arange(trees, dtype=np.int32) * width
        leaf = self.feature.ravel() < 0
        feature = np.where(leaf, 0, self.feature.ravel()).astype(np.int32)
        threshold = self.threshold.ravel()
        base = np.repeat(root, width)
        children = np.stack([self.children[0].ravel() + base, self.children[1].ravel() + base])
        children[:, leaf] = np.flatnonzero(leaf)
        children = children.T.ravel().astype(np.int32)  # right child, left child of each node
        path_length = self.path_length.ravel()
        scale = average_path(self.sample_size) or 1.0
        result = np.empty(len(points))
        for start in range(0, len(points), WALKED):
            block = points[start : start + WALKED]
            values = block.ravel()
            row = (np.arange(len(block), dtype=np.int32) * block.shape[1])[:, None]
            node = np.broadcast_to(root, (len(block), trees))
            while True:
                left = values.take(row + feature.take(node)) <= threshold.take(node)
                following = children.take(node * 2 + left)
                if np.array_equal(following, node):
                    break
                node = following
            mean = path_length.take(node).mean(axis=1)
            result[start : start + WALKED] = -np.exp2(-mean / scale)
        return result

    def decision(self, features: Column) -> Column:
        """Decision value per feature array: below 0 for the most isolated training share."""
        forest = self

        @F.pandas_udf("double")
        def decide(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype="float64")
            points = np.stack(vectors.to_numpy()).astype(np.float64)
            return pd.Series(forest.raw_scores(points) - forest.offset)

        return decide(features)

    def scores(self, featured: DataFrame, scope: str = "batch") -> DataFrame:
        """Adds ``iforest_score``.

        With ``scope='batch'`` the decision values are needed twice, for their range and for the
        scores, so the rows are stored with them rather than walked through the trees again.
        ``scope='model'`` takes the range of the training rows, so a row's score depends on nothing
        but the row and the model; values outside of the range score 0 or 1.
        """
        if scope == "row":
            return featured.withColumn("iforest_score", F.lit(1.0))
        if scope == "model":
            score = inverted_minmax(F.col("_decision"), F.lit(self.low), F.lit(self.high))
            return (
                featured.withColumn("_decision", self.decision(F.col("features")))
                .withColumn("iforest_score", score).drop("_decision")
            )
        decided = stored(
            featured.withColumn("_decision", self.decision(F.col("features"))), "decisions"
        )
        return decided.withColumn(
            "iforest_score", minmax_scores(decided, "_decision", scope)
        ).drop("_decision")

    def save(self, spark: SparkSession, root: str, version: int) -> None:
        trees, nodes = self.feature.shape
        tree, node = np.divmod(np.arange(trees * nodes), nodes)
        frame = pd.DataFrame(
            {
                "tree": tree.astype("int32"),
                "node": node.astype("int32"),
                "feature": self.feature.ravel().astype("int32"),
                "threshold": self.threshold.ravel(),
                "left_child": self.children[1].ravel().astype("int32"),
                "right_child": self.children[0].ravel().astype("int32"),
                "path_length": self.path_length.ravel(),
                "sample_size": np.int32(self.sample_size),
                "offset": self.offset,
                "low": self.low,
                "high": self.high,
            }
        )
        write_snapshot(spark.createDataFrame(frame, MODEL_SCHEMA).coalesce(1), root, version)

    @classmethod
    def load(
        cls, spark: SparkSession, root: str, version: int | None = None
    ) -> IsolationForest | None:
        """The given or latest saved version; None when there is none."""
        version = latest_version(spark, root) if version is None else version
        if version is None:
            return None
        schema = spark.createDataFrame([], MODEL_SCHEMA).schema
        nodes = read_snapshot(spark, root, schema, version).toPandas()
        first = nodes.iloc[0]
        ends = [float(first[name]) for name in ("offset", "low", "high")]
        return cls._from_nodes(nodes, int(first["sample_size"]), *ends)
