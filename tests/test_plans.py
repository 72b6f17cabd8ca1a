"""Plan checks: no cartesian products, no Python in the reference's own
queries, partial limits before shuffles, filters at the scan."""

import pytest

from conftest import SF_SMALL

from __spark_entry__ import queries


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {n: _plan(fn(spark, SF_SMALL)) for n, fn in queries().items()}


def test_no_cartesian_products(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_no_python_functions(plans):
    assert {n for n, p in plans.items() if "ArrowEvalPython" in p or "BatchEvalPython" in p} == set()


@pytest.mark.parametrize("name", ["dedup_first", "top_posts", "members_join", "request_plan", "union_dedup"])
def test_partial_group_limit_before_shuffle(plans, name):
    p = plans[name]
    assert "WindowGroupLimit" in p and "Partial" in p


def test_filter_and_columns_reach_the_scan(plans):
    p = plans["child_attach"]
    assert "Not(EqualTo(s_nationkey,0))" in p
    assert "ReadSchema: struct<s_suppkey:bigint,s_name:string,s_nationkey:int>" in p


def test_payload_parsed_once_under_a_filter(plans):
    # media_multi filters on the media type; the detail JSON must still be
    # parsed by exactly one from_json in the physical plan
    assert plans["media_multi"].count("from_json(StructField(id") == 1
