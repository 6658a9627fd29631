"""Every registered query against its SQL in DuckDB on the smallest tables, and a look at its
plan: no cross join, no nested loop."""

import os
import re
import sys

import pytest

from gradeloom.plans.catalog import ALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check_oracle  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", list(ALL))
def test_query_equals_sql(spark, con, name):
    fn, sql = ALL[name]
    df = fn(spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    if sql:
        assert check_oracle.compare(df, con, sql) is None
    else:
        assert df.count() >= 0


def test_entry_and_contract(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
