"""Every core query beside its SQL on the smallest tables, and the shape of some plans."""

import oracle
import pytest

from lonja.plans import registry

WITH_SQL = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_sql(spark, small, con, name):
    assert oracle.compare(spark, con, registry.queries()[name], registry.oracle_sql()[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(WITH_SQL)))
def test_query_runs(spark, small, name):
    assert registry.queries()[name](spark, small).columns


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark, small):
    q = registry.queries()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan(q["src4_parquet_pushdown"](spark, small)) and "l_comment" not in plan(q["src4_parquet_pushdown"](spark, small))
    assert "WindowGroupLimit" in plan(q["win1_top3_by_group"](spark, small))
    assert "TakeOrderedAndProject" in plan(q["top1_top5"](spark, small))
    assert "CartesianProduct" not in plan(q["q4_recommendations"](spark, small))
