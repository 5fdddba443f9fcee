"""Every registered query on the smallest tables, against its SQL counterpart where it has one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as driver  # noqa: E402
from tools.check_queries import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_every_sql_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 60


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, connection, name):
    table = driver.queries()[name](spark, SF).toArrow()
    sql = driver.oracle_sql().get(name)
    if sql is not None:
        assert compare(table, connection.sql(sql).to_arrow_table()) == ""
    else:
        assert table.num_rows > 0
