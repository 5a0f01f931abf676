"""The driver contract."""

import os

import pytest

import __spark_entry__ as driver


@pytest.mark.skipif(not os.path.isdir(driver.SMOKE_DIR), reason="no test tables")
def test_entry_gives_a_row_for_each_column(spark):
    rows = driver.entry(spark).collect()
    assert {r.column_name for r in rows} >= {"l_orderkey", "l_shipdate"} and all(r.row_count > 0 for r in rows)


def test_sql_belongs_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert all(callable(f) for f in driver.queries().values())
