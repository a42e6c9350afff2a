"""Plans: what is read, and that no pair join is a product."""

import pytest

from tidewire.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "columns"),
    [("domain_rollup", "struct<url:string>"), ("archive_recovery", "struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>"), ("canonical_per_event", "struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>")],
)
def test_only_needed_columns_are_read(spark, name, columns):
    assert f"ReadSchema: {columns}" in plan(registry.queries()[name](spark, SF))


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(o_totalprice)" in plan(registry.queries()["archive_recovery"](spark, SF))


@pytest.mark.parametrize("name", ["overlapping_titles", "recent_candidates", "archive_lookup", "alternate_sources", "image_assignment", "source_profile", "resolve_cascade"])
def test_no_products(spark, name):
    p = plan(registry.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
