import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.models import autoencoder
from palisade.models.autoencoder import WEIGHTS, Autoencoder, _gradient, initial_weights, reconstruct
from palisade.models.isolation_forest import IsolationForest, average_path, tree_samples
from palisade.models.registry import Models, load_models, newest_version, retrain, train_models
from palisade.session import stored, work_folder

FIELDS = "id bigint, features array<float>, label string"


def vectors(spark, rows=600, outliers=6, seed=3):
    draw = np.random.default_rng(seed)
    points = draw.normal(size=(rows, 12))
    points[:outliers] += 9.0
    data = [(nth, [float(x) for x in point], None) for nth, point in enumerate(points)]
    return stored(spark.createDataFrame(data, FIELDS), "vectors")


@pytest.fixture(scope="module")
def rows(spark):
    return vectors(spark)


@pytest.fixture(scope="module")
def forest(rows):
    return IsolationForest.fit(rows, trees=60)


def test_unfitted_models_score_one_half(rows):
    scored = Models().with_scores(rows).agg(
        F.min("iforest_score"), F.max("iforest_score"), F.min("ae_score"), F.max("ae_score")
    )
    assert tuple(scored.first()) == (0.5, 0.5, 0.5, 0.5)
    assert {row[0] for row in Models().score(rows, mode="iforest").select("anomaly_score").collect()} == {0.5}


def test_average_path():
    assert [average_path(size) for size in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_samples_are_uniform_without_replacement(spark):
    table = spark.range(5000).select("id", F.array(F.col("id").cast("float")).alias("features"))
    sampled = tree_samples(table, 5000, trees=20, size=100)
    per_tree = sampled.groupBy("tree").agg(
        F.count("*").alias("n"), F.count_distinct("features").alias("d"),
        F.avg(F.col("features")[0]).alias("mean"),
    ).collect()
    assert len(per_tree) == 20 and {(row["n"], row["d"]) for row in per_tree} == {(100, 100)}
    assert np.mean([row["mean"] for row in per_tree]) == pytest.approx(2500, abs=200)
    again = tree_samples(table.repartition(7), 5000, trees=20, size=100)
    assert sampled.exceptAll(again).count() == 0


def test_outliers_rank_on_top(rows, forest):
    scored = forest.scores(rows)
    top = scored.orderBy(F.desc("iforest_score")).limit(6)
    assert {row["id"] for row in top.collect()} == set(range(6))
    low, high = scored.agg(F.min("iforest_score"), F.max("iforest_score")).first()
    assert low == pytest.approx(0.0, abs=1e-6) and high == 1.0


def test_five_percent_of_the_training_rows_are_below_the_offset(rows, forest):
    below = rows.select(forest.decision(F.col("features")).alias("d")).where("d < 0").count()
    assert below == 30


def test_row_scope_scores_one(rows, forest):
    assert forest.scores(rows, "row").agg(F.min("iforest_score")).first()[0] == 1.0


def test_model_scope_does_not_depend_on_the_other_rows(spark, rows, forest):
    whole = {r["id"]: r["iforest_score"] for r in forest.scores(rows, "model").collect()}
    part = {r["id"]: r["iforest_score"] for r in forest.scores(rows.where("id % 7 = 1"), "model").collect()}
    assert part and all(whole[key] == value for key, value in part.items())
    by_batch = {r["id"]: r["iforest_score"] for r in forest.scores(rows).collect()}
    assert whole == pytest.approx(by_batch, abs=1e-9)  # the training rows as one batch
    root = work_folder(spark, "forest")
    forest.save(spark, root, 1)
    loaded = IsolationForest.load(spark, root)
    assert (loaded.low, loaded.high) == (forest.low, forest.high) and loaded.low < 0 < loaded.high


def test_fits_repeat(rows, forest):
    again = IsolationForest.fit(rows.repartition(5), trees=60)
    assert np.array_equal(again.threshold, forest.threshold) and again.offset == forest.offset


def test_an_epoch_moves_no_rows(spark):
    """Buckets are packed once, one row each, and an epoch reads them where they are."""
    rows = spark.createDataFrame(
        [([float(i % 7), *[float(i)] * 11], i % 3 + 1) for i in range(60)], "features array<float>, copies bigint"
    )
    dealt = autoencoder._dealt(rows, 5, seed=1)
    packed = autoencoder._buckets(dealt, 5).persist()
    try:
        found = {}
        for row in packed.collect():
            vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, 12)
            copies = np.frombuffer(row["copies"], np.int64)
            found[row["bucket"]] = sorted((tuple(v), int(n)) for v, n in zip(vectors.tolist(), copies))
        want = {}
        for row in dealt.collect():
            want.setdefault(row["bucket"], []).append((tuple(row["features"]), row["copies"]))
        assert found == {number: sorted(held) for number, held in want.items()}
        state = np.concatenate([initial_weights(1), np.zeros(2 * WEIGHTS), [0.0]])
        train = autoencoder._train_epoch(state, np.zeros(12), np.ones(12), 1, 0, 8, 1e-3)
        epoch = packed.mapInPandas(train, autoencoder._STATE)
        plan = epoch._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" in plan and not plan.split("InMemoryRelation")[0].count("Repartition")
        states = {row["bucket"]: row["rows"] for row in epoch.collect()}
        assert states == {number: sum(n for _, n in held) for number, held in want.items()}
    finally:
        packed.unpersist()


def test_gradient_matches_differences():
    draw = np.random.default_rng(0)
    weights, points = initial_weights(1), draw.normal(size=(5, 12))
    assert len(weights) == WEIGHTS == 2164

    class NoDropout:
        def random(self, shape):
            return np.ones(shape)

    kept = (1.0 - 0.1) ** -1  # the gate scales what it keeps
    gradient = _gradient(weights, points, NoDropout())

    def loss(w):
        value = points
        start = 0
        for nth, (a, b) in enumerate([(12, 32), (32, 16), (16, 8), (8, 16), (16, 32), (32, 12)]):
            value = value @ w[start : start + a * b].reshape(a, b) + w[start + a * b : start + a * b + b]
            start += a * b + b
            if nth < 5:
                value = np.maximum(value, 0.0) * (kept if nth in (0, 4) else 1.0)
        return ((value - points) ** 2).mean()

    for place in draw.integers(0, WEIGHTS, 25):
        step = np.zeros(WEIGHTS)
        step[place] = 1e-6
        slope = (loss(weights + step) - loss(weights - step)) / 2e-6
        assert gradient[place] == pytest.approx(slope, rel=1e-3, abs=1e-7)


def test_autoencoder_learns_and_ranks(rows):
    normal = rows.where("id >= 6")
    short, long = (Autoencoder.fit(normal, epochs=n, rate=5e-3) for n in (1, 12))

    def mean_error(model):
        return normal.agg(F.avg(model.error(F.col("features")))).first()[0]

    assert mean_error(long) < mean_error(short)
    above = normal.where(long.error(F.col("features")) > long.threshold).count()
    assert above == pytest.approx(0.05 * 594, abs=2)
    scored = rows.select("id", long.score(F.col("features")).alias("s"))
    assert scored.where("id < 6").agg(F.min("s")).first()[0] == 1.0
    assert scored.where("s < 0 OR s > 1").count() == 0
    assert np.array_equal(Autoencoder.fit(normal, epochs=1, rate=5e-3).weights, short.weights)


@pytest.mark.parametrize("standardize", [False, True])
def test_autoencoder_does_not_depend_on_layout(rows, monkeypatch, standardize):
    monkeypatch.setattr(autoencoder, "ROWS_PER_BUCKET", 30)  # 30 buckets and more
    monkeypatch.setattr(autoencoder, "FOLD", 4)
    monkeypatch.setattr(autoencoder, "PIECE", 8)
    # A third of the rows are one vector.
    hot = rows.where("id = 7").select("features", F.explode(F.sequence(F.lit(1), F.lit(300))).alias("n"))
    log = rows.select("features").unionByName(hot.select("features"))
    fits = [
        Autoencoder.fit(laid_out, epochs=2, rate=5e-3, standardize=standardize)
        for laid_out in (
            log.repartition(1), log.orderBy(F.desc("features")).coalesce(4), log.repartition(9))
    ]
    for other in fits[1:]:
        assert np.array_equal(fits[0].weights, other.weights)
        assert np.array_equal(fits[0].scale, other.scale)
        assert other.threshold == pytest.approx(fits[0].threshold, rel=1e-9)


def test_no_bucket_holds_a_hot_vector(spark):
    counted = spark.createDataFrame(
        [([1.0] * 12, 700_001), *[([float(n)] * 12, 3) for n in range(2, 302)]],
        "features array<float>, copies bigint",
    )
    dealt = autoencoder._dealt(counted, 40, seed=1)
    assert dealt.agg(F.sum("copies")).first()[0] == 700_901
    assert dealt.agg(F.max("copies")).first()[0] == autoencoder.PIECE
    sizes = dealt.groupBy("bucket").agg(F.sum("copies").alias("n")).toPandas()["n"]
    assert len(sizes) == 40 and sizes.max() < 2 * sizes.median()


def test_autoencoder_equals_plain_adam(spark):
    """One bucket is mini-batch Adam over all rows, one step after the other."""
    draw = np.random.default_rng(3)
    points = draw.integers(0, 3, (500, 12)).astype(np.float32)
    frame = spark.createDataFrame([(row.tolist(),) for row in points], "features array<float>")
    model = Autoencoder.fit(frame, epochs=3, batch_size=64, rate=1e-2, seed=5)
    points = points[np.lexsort(points.T)].astype(float)
    weights, mean, square, step = initial_weights(5), 0.0, 0.0, 0
    for epoch in range(3):
        random = np.random.default_rng([5, epoch, 0])
        shuffled = points[random.permutation(500)]
        for start in range(0, 500, 64):
            slope = _gradient(weights, shuffled[start : start + 64], random)
            step += 1
            mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope * slope
            weights = weights - 0.01 * (mean / (1 - 0.9**step)) / (
                (square / (1 - 0.999**step)) ** 0.5 + 1e-8)
    assert model.weights == pytest.approx(weights, rel=1e-9, abs=1e-12)
    errors = ((reconstruct(weights, points) - points) ** 2).mean(axis=1)
    assert model.threshold == pytest.approx(np.percentile(errors, 95), rel=1e-9)


def test_autoencoder_without_rows(rows):
    with pytest.raises(ValueError):
        Autoencoder.fit(rows.where("false"), epochs=1)


def test_standardized_autoencoder(rows):
    model = Autoencoder.fit(rows, epochs=1, standardize=True)
    assert model.scale.min() > 0.9 and not np.array_equal(model.shift, np.zeros(12))
    assert reconstruct(model.weights, np.zeros((1, 12))).shape == (1, 12)


def test_store_swap_and_gate(spark, rows):
    root = work_folder(spark, "models")
    start = load_models(spark, root)
    assert newest_version(spark, root) is None and start.name == "v0"
    first = train_models(rows, root, epochs=1)
    loaded = load_models(spark, root, start)
    assert loaded.name == "v1" and load_models(spark, root, loaded) is loaded
    vector = F.col("features")
    same = rows.select(
        F.abs(first.forest.decision(vector) - loaded.forest.decision(vector)).alias("f"),
        F.abs(first.autoencoder.error(vector) - loaded.autoencoder.error(vector)).alias("a"),
    ).agg(F.max("f"), F.max("a")).first()
    assert tuple(same) == (0.0, 0.0)
    assert retrain(rows, root, epochs=1) == (False, 1)  # no labels
    few = rows.where("id < 60").withColumn("label", F.lit("normal"))
    assert retrain(few, root, epochs=1) == (False, 1)  # too few rows
    labelled = rows.withColumn("label", F.when(F.col("id") < 50, "normal"))
    assert retrain(labelled, root, epochs=1) == (True, 2)
    assert load_models(spark, root, loaded).name == "v2"
    scored = load_models(spark, root).score(rows.withColumns({
        "ip_fail_count_1m": F.lit(0), "is_auth_endpoint": F.lit(0.0), "burst_rate": F.lit(0.0),
        "path": F.lit("/"),
    }))
    assert scored.where("anomaly_score < 0 OR anomaly_score > 1").count() == 0
