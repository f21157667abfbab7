import random

import pytest
from pyspark.sql import functions as F

from palisade.functions import rules, scoring
from palisade.functions.text import three_decimals
from palisade.operators.quantiles import ordered_image, percentile
from palisade.operators.scoring import apply_rules, hybrid, minmax_scores, score_events

FIELDS = (
    "id int, ip_fail_count_1m bigint, is_auth_endpoint double, burst_rate double, path string, "
    "ml double"
)


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(
        [
            (1, 10, 1.0, 0.0, "/login", 0.5),  # brute force at its threshold
            (2, 9, 1.0, 0.0, "/login", 0.5),  # one failure short
            (3, 50, 0.0, 0.0, "/index", 0.5),  # not an auth path
            (4, 0, 0.0, 40.0, "/index", 1.0),  # flood at its threshold
            (5, 0, 0.0, 39.8, "/WP-Admin/x", 0.1),  # keyword in any case
            (6, 0, 0.0, 0.0, "/a/..%2F..%2fb", 0.9),
            (7, 12, 1.0, 90.0, "/admin", 0.0),  # first rule wins
            (8, 0, 0.0, 0.0, "/index", 0.7),  # not above the cutoff
            (9, 0, 0.0, 0.0, "/index", 0.7000001),
            (10, 0, 0.0, 0.0, "/index", 1.3),  # capped
        ],
        FIELDS,
    )


def test_rules(cases):
    found = {
        row["id"]: (row["rule_type"], row["rule_score"]) for row in apply_rules(cases).collect()
    }
    assert found == {
        1: ("brute_force", 1.0), 2: (None, 0.0), 3: (None, 0.0), 4: ("ddos_spike", 1.0),
        5: ("suspicious_api", 0.8), 6: ("suspicious_api", 0.8), 7: ("brute_force", 1.0),
        8: (None, 0.0), 9: (None, 0.0), 10: (None, 0.0),
    }


def test_hybrid(cases):
    found = {
        row["id"]: (pytest.approx(row["anomaly_score"]), row["attack_type"])
        for row in hybrid(cases, F.col("ml")).collect()
    }
    assert found == {
        1: (0.9, "brute_force"), 2: (0.5, None), 3: (0.5, None), 4: (1.0, "ddos_spike"),
        5: (0.72, "suspicious_api"), 6: (0.86, "suspicious_api"), 7: (0.9, "brute_force"),
        8: (0.7, None), 9: (0.7000001, "anomaly"), 10: (1.0, "anomaly"),
    }


def test_modes(cases):
    def score(mode, **models):
        rows = score_events(cases, mode, **models).where("id = 9").collect()
        return rows[0]["anomaly_score"], rows[0]["attack_type"]

    assert score("iforest", iforest=F.lit(0.7)) == (0.7, None)
    assert score("iforest", iforest=F.lit(0.71)) == (0.71, "anomaly")
    assert score("autoencoder", autoencoder=F.lit(0.9)) == (0.9, "anomaly")
    assert score("autoencoder") == (0.5, None)
    assert score("hybrid", iforest=F.lit(1.0), autoencoder=F.lit(0.5)) == (0.75, "anomaly")
    assert score("other", iforest=F.lit(1.0)) == (0.5, None)


def test_bands(spark):
    values = [0.0, 0.2500001, 0.45, 0.4500001, 0.5, 0.7, 0.85, 0.9, 0.95, 1.0]
    frame = spark.createDataFrame([(value,) for value in values], "v double")
    rows = frame.select(
        scoring.alert_severity(F.col("v")),
        scoring.table_band(F.col("v")),
        scoring.reputation_tag(F.col("v")),
    ).collect()
    assert [row[0] for row in rows] == ["low"] * 5 + ["medium", "high", "high"] + ["critical"] * 2
    assert [row[1] for row in rows] == (
        ["low"] * 4 + ["medium", "high", "high"] + ["critical"] * 3
    )
    assert [row[2] for row in rows] == ["blocked", "suspicious", "suspicious"] + ["trusted"] * 7


def test_minmax_scopes(spark):
    frame = spark.createDataFrame([(-0.2,), (0.0,), (0.3,)], "d double")
    batch = [row[0] for row in frame.select(minmax_scores(frame, "d")).collect()]
    assert batch == pytest.approx([1.0, 0.6, 0.0], abs=1e-6)
    assert [row[0] for row in frame.select(minmax_scores(frame, "d", "row")).collect()] == [1.0] * 3
    with pytest.raises(ValueError):
        minmax_scores(frame, "d", "table")


def test_three_decimals_round_like_exact_arithmetic(spark):
    values = [0.0, 0.0005, 0.00049999, 0.0085, 0.0625, 0.1875, 0.8125, 0.8365, 0.9995, 1.0, 0.7005]
    values += [nth / 2000 for nth in range(2001)]
    frame = spark.createDataFrame([(value,) for value in values], "v double")
    for value, text in frame.select("v", three_decimals(F.col("v"))).collect():
        assert text == f"{value:.3f}", value


def test_auth_paths_are_case_sensitive(spark):
    frame = spark.createDataFrame([("/api/auth",), ("/Login",), ("/x/ssh",)], "p string")
    assert [row[0] for row in frame.select(rules.is_auth_path(F.col("p"))).collect()] == [1, 0, 1]


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_percentile_is_exact_for_any_spread(spark, share):
    draw = random.Random(7)
    sets = [
        [draw.gauss(0, 1) for _ in range(501)],
        [draw.choice([-1e300, -1e-300, -0.0, 0.0, 5e-324, 1e-5, 3.0, 1.7e308]) for _ in range(200)],
        [2.5] * 40 + [2.5000000000000004] * 3,
        [-3.25],
    ]
    for values in sets:
        frame = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3)
        place = share * (len(values) - 1)
        low, high = sorted(values)[int(place)], sorted(values)[min(int(place) + 1, len(values) - 1)]
        wanted = low if low == high else low + (high - low) * (place - int(place))
        assert percentile(frame, "v", share) == wanted
    assert percentile(spark.createDataFrame([(None,)], "v double"), "v", share) is None


def test_images_keep_the_order_of_doubles(spark):
    values = [float("-inf"), -1e10, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e10, float("inf"), float("nan")]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    images = [r[0] % 2**64 for r in frame.orderBy("i").select(ordered_image(F.col("v"))).collect()]
    assert images == sorted(images) and len(set(images)) == len(images)
