"""Plan shapes: no cross joins anywhere, top-k without a global sort, pruned scans."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

NAMES = sorted(n for n in E.oracle_sql() if not n.startswith("stream_"))


def plan_text(df) -> str:
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString() + qe.optimizedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join(spark, name):
    text = plan_text(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_single_target_topk(spark):
    text = plan_text(E.queries()["similar_districts"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in text


def test_site_scan_is_pruned(spark):
    df = E.queries()["zone_counts"](spark, SF_SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in text
