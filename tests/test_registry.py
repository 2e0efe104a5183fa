"""Every registered query runs, and matches its SQL in DuckDB where it has one."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import database, differences

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    frame = queries()[name](spark, SMALL)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for slow in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython"):
        assert slow not in plan
    found = [tuple(row) for row in frame.collect()]
    if name in oracle_sql():
        assert differences(frame.columns, found, db, oracle_sql()[name]) == []
    else:
        assert found


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert [r["variable"] for r in entry(spark).orderBy("place").collect()][:2] == [
        "spend_plan",
        "final_result",
    ]
