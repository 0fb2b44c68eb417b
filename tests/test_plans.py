"""Physical plans of the registered queries, with no side small enough to broadcast."""

import os

import pytest
from conftest import plan_of

import __spark_entry__ as registry

SF_DIR = "/root/testdata/sf0.001"
PYTHON = {"function_sum", "function_sum_double"}
OPTIONAL = set(registry.llm.queries()) if registry.llm else set()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture
def plan(spark, conf, request):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    return plan_of(registry.queries()[request.param](spark, SF_DIR))


@pytest.mark.parametrize("plan", sorted(set(registry.queries()) - OPTIONAL), indirect=True)
def test_plans_hold_no_costly_operators(plan, request):
    costly = ["CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastExchange", "Window"]
    if request.node.callspec.params["plan"] not in PYTHON:
        costly += ["MapInPandas", "ArrowEvalPython", "BatchEvalPython"]
    assert [operator for operator in costly if operator in plan] == []


@pytest.mark.parametrize(
    "plan, columns",
    [
        ("top_rated", ["struct<p_partkey:bigint,p_name:string,p_size:int>", "struct<l_partkey:bigint,l_quantity:double>"]),
        ("rated_left_star", ["struct<doc_id:bigint,source:string>", "struct<doc_id:bigint,quality:int>"]),
        ("token_counts", ["struct<p_name:string,p_brand:string,p_type:string>"]),
        ("suffix_hist", ["struct<p_name:string,p_size:int>"]),
        ("epoch_year_hist", ["struct<l_shipdate:timestamp_ntz>"]),
        ("group_count", ["struct<l_returnflag:string,l_linestatus:string>"]),
        ("filtered_sum", ["struct<l_suppkey:bigint,l_extendedprice:double>"]),
        ("chart_pivot", ["struct<l_quantity:double,l_returnflag:string,l_linestatus:string>"]),
    ],
    indirect=["plan"],
)
def test_scans_read_only_what_the_report_needs(plan, columns):
    assert sorted(line.split(": ", 1)[1] for line in plan.splitlines() if line.startswith("ReadSchema")) == sorted(columns)


@pytest.mark.parametrize(
    "plan, pushed",
    [
        ("filtered_sum", "LessThan(l_suppkey,25)"),
        ("top_rated", "IsNotNull(l_partkey)"),
    ],
    indirect=["plan"],
)
def test_filters_reach_the_scan(plan, pushed):
    assert pushed in plan


@pytest.mark.parametrize("plan", ["top_rated", "epoch_year_hist", "limit_rows"], indirect=True)
def test_top_k_is_not_a_full_sort(plan):
    assert "TakeOrderedAndProject" in plan
