"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as driver
from compare import difference
from tablehaul.workloads import ORACLES, QUERIES


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_the_driver_gets_every_query():
    assert QUERIES.items() <= driver.queries().items()
    assert ORACLES.items() <= driver.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, db, data):
    assert difference(QUERIES[name], ORACLES[name], spark, db, data) is None


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["user_id", "username", "order_count"]
    assert df.count() > 0
