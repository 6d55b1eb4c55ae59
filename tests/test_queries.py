"""Every registered query: equal to its SQL, and no join without an equality."""

import pytest

import __spark_entry__ as entry
from cohorta.plans import QUERIES, SQL
from tests.check_queries import compare, duck

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    plan = plan_text(df)
    assert not [word for word in FORBIDDEN if word in plan]
    assert compare(df, con, SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["day", "variant", "n_view", "n_click", "n_purchase"]
    rows = df.collect()
    assert rows and all(r.n_view >= r.n_click >= r.n_purchase for r in rows)
