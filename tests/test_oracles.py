"""Every registered query equals its SQL oracle in columns, types and rows."""

import pytest

import __spark_entry__ as entry
from fixtures import checks, oracles
from fixtures.compare import difference


def test_every_query_has_an_oracle():
    assert set(checks.QUERIES) == set(oracles.sql())
    assert set(checks.QUERIES) <= set(entry.queries())
    assert set(oracles.sql()) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["event_date", "event_class", "rows"]
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_query_equals_oracle(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan
    assert difference(df, con, entry.oracle_sql()[name]) is None
