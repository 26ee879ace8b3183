"""Physical plans of every oracle-checked query: no cartesian / nested-loop
joins, no Python UDF evaluation, and scans prune columns."""
import contextlib
import io

import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from claimwise.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(name for name, (_, sql) in REGISTRY.items() if sql))
def test_plan_has_no_cross_join_or_python(spark, name):
    plan = _plan(REGISTRY[name][0](spark, SF))
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op}"


def test_policy_scan_prunes_and_pushes(spark):
    plan = _plan(REGISTRY["a01_policy_scan"][0](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_returnflag:string>" in plan
    assert "PushedFilters: [IsNotNull(o_custkey)]" in plan
