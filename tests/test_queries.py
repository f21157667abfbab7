"""Every registered query on the smallest data, next to its SQL where it has one."""

import os

import pytest

import __spark_entry__ as registered
from compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(registered.queries()))
def test_query(spark, connection, name):
    found, _, rows = difference(
        spark, connection, name, registered.queries()[name], registered.oracle_sql().get(name),
        SF_DIR,
    )
    assert not found
    assert rows or name in registered.oracle_sql()


def test_entry(spark):
    result = registered.entry(spark)
    assert result.columns == ["id", "anomaly_score", "attack_type"]
    assert {row["attack_type"]: row["count"] for row in result.groupBy("attack_type").count().collect()} == {
        "anomaly": 20, "brute_force": 430, "ddos_spike": 173, "suspicious_api": 79,
    }


def test_every_oracle_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())
