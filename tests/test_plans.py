"""Plan shape guards: no cartesian products or nested-loop joins in any
SQL-checked query (the fitted-model queries are exercised elsewhere)."""

import pytest

from conftest import SMOKE_DIR
from shelfwise.plans import ORACLE, QUERIES


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_no_cross_or_nested_loop_join(spark, key):
    plan = QUERIES[key](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_adapter_scan_prunes_and_pushes_filters(spark):
    from shelfwise.sources.adapter import RetailTables
    rt = RetailTables.of(spark, SMOKE_DIR)
    plan = rt.fulfilment_orders._jdf.queryExecution().executedPlan().toString()
    # join keys are checked in the scans; lineitem reads only needed columns
    assert "PushedFilters: [IsNotNull(" in plan
    assert "l_extendedprice" not in plan
