"""Physical-plan properties of every registered query (executed adaptive plan)."""

import re

import pytest

import __spark_entry__ as E
from streamwatch.plans.jobs import JOBS

SF = "/root/testdata/sf0.001"
# how many times a query may read the events table (see README, "Read once")
EVENT_READS = {"reconcile": 4, "reconcile_ok": 2, "last_view": 2}
GROUP_LIMIT = {"hot_items", "hot_pages", "ad_blacklist_alerts", "ad_blacklist_counts"}
FILTERED = {"hot_items", "pv_uv", "pv_uv_sql", "uv_approx", "uv_bloom", "channel_promo", "ad_by_region", "ad_rollup", "last_view",
            "order_timeout", "reconcile", "reconcile_ok"}


def executed_plan(df) -> str:
    qe = df._jdf.queryExecution()
    qe.toRdd().count()  # run it, so the adaptive plan is final
    return qe.executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(JOBS))
def test_plan_properties(spark, name):
    plan = executed_plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan  # no Python UDFs
    reads = plan.count("events.parquet")
    assert 1 <= reads <= EVENT_READS.get(name, 1), (name, reads)
    if name in GROUP_LIMIT:
        assert "WindowGroupLimit" in plan
    if name in FILTERED:
        assert re.search(r"PushedFilters: \[[^\]]*event_type", plan), name
    # column pruning: no query reads the whole events row
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string>" not in plan
