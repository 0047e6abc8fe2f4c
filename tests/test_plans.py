"""
Python evaluation, no cartesian product or nested-loop join, and a
single-partition exchange only above a global partial aggregate (one row per
task), never above data that grows."""

import pytest

from conftest import SF_SMALL

from tallyframe.plans.registry import QUERIES

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op} in plan"
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1] if i + 1 < len(lines) else ""
            assert "HashAggregate(keys=[]" in child, f"{name}: single-partition exchange over {child.strip()}"
