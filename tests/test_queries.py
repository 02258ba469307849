"""Every registered query against its SQL, over whole tables at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, name):
    df = queries()[name](spark, SF)
    if name in oracle_sql():
        assert compare(df, tables(SF), oracle_sql()[name]) is None
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_nearest_plan_has_no_cartesian_product(spark):
    plan = queries()["nearest_points"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_latest_price_shuffles_once_and_prunes_columns(spark):
    plan = queries()["latest_price"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "l_discount" not in plan
