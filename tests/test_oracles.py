"""Every registered query against its SQL text, on the smallest tables."""

import pytest

import __spark_entry__ as driver
from oracle_check import canonical, compare, connect

SF = "/root/testdata/sf0.001"
SQL = driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF, driver.queries()[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    df = driver.queries()[name](spark, SF)
    assert canonical(df.collect(), df.columns)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 50
