"""Every registered query against its check SQL on the smallest test tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def engine():
    from compare import connect

    return connect(SF)


def _names():
    from placegrid import queries

    return sorted(queries.all_queries())


@pytest.mark.parametrize("name", _names() if os.path.isdir(SF) else [])
def test_query(spark, engine, name):
    import __spark_entry__ as entry
    from compare import check

    ok, text, _ = check(name, entry.queries()[name], entry.oracle_sql().get(name), spark, SF, engine)
    assert ok, text


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25


def test_every_query_has_a_check():
    import __spark_entry__ as entry
    from placegrid import queries

    assert set(queries.all_checks()) == set(queries.all_queries())
    assert set(queries.all_queries()) <= set(entry.queries())


def _headline():
    import bench

    return bench.HEADLINE


@pytest.mark.parametrize("name", _headline())
def test_plans_stay_distributed(spark, name):
    """No cross join, no nested loop, no Python in the plan of a headline query."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert node not in plan
