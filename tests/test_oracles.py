"""Every library query that has SQL gives the same rows in DuckDB at the smallest size."""

import math
import os

import duckdb
import pytest

from shapelab import registry, registry_plans, registry_structure  # noqa: F401
from shapelab.session import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return "nan" if math.isnan(float(v)) else float(f"{float(v):.9g}")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    relation = duck.sql(registry.ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in relation.fetchall())
