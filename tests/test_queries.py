"""Every registered query against its SQL, on the small tables."""

import pytest

import __spark_entry__ as driver
from tillroll_checks.compare import compare, connect
from tillroll_checks.oracle import ORACLE
from tillroll_checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF_DIR, name) == ""


def test_entry(spark):
    rows = driver.entry(spark)
    assert rows.count() > 0
    assert rows.columns[:4] == ["payment_provider", "realm", "payment_period", "charge_date"]
