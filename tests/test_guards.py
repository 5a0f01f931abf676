"""Refusals, classes of failures, time limits of facts; exact places of a column's order."""

import time

import numpy as np
import pytest

from shapelab.operators import profile
from shapelab.sources import describe, guards


def test_hosts_and_roles_are_refused():
    home = guards.source_digest("localhost")
    guards.check_host(None, "db") or guards.check_host(home, "db.example") or guards.check_write_target(home, "db.example")
    for host in ("localhost", "LOCALHOST.", "127.0.0.1", "::1"):
        with pytest.raises(guards.ToolError):
            guards.check_host(home, host)
    with pytest.raises(guards.ToolError):
        guards.check_write_target(None, "db")
    guards.check_write_target(None, "db", sure=True)
    with pytest.raises(guards.ToolError) as refused:
        guards.check_access(True)
    assert refused.value.category == "bad_usage" and guards.ToolError("odd", "x").category == "internal"
    guards.check_access(True, sure=True)


def test_a_slow_fact_is_left_out(spark):
    began = time.time()
    done, late = guards.within(spark, 2.0, {"quick": lambda: spark.range(5).count(), "slow": lambda: spark.range(10**13).selectExpr("sum(hash(id))").collect(), "after": lambda: 7})
    assert done == {"quick": 5, "after": 7} and late == ["slow"] and time.time() - began < 60
    with pytest.raises(ZeroDivisionError):
        guards.within(spark, 5.0, {"wrong": lambda: 1 / 0})


def test_a_cut_index_says_so():
    doc = {"tables": {f"t{i}": {"rows": 1, "columns": {}} for i in range(3)}}
    assert describe.index(doc, 2)["truncated"]["total"] == 3 and "truncated" not in describe.index(doc)


@pytest.mark.parametrize("values", [[], [5.0], [0.0, 1.0], [1.0] * 900, [float(i % 7) for i in range(3000)], [i * 1.5 if i % 3 else None for i in range(999)]])
def test_histogram_places_are_exact(spark, values):
    got = profile.histogram(spark.createDataFrame([(v,) for v in values], "x double"), "t", ["x"]).first().bounds
    real = [v for v in values if v is not None]
    assert (got is None) if not real else np.allclose(got, np.percentile(real, [i * 6.25 for i in range(17)]), atol=1e-6)
