"""Physical plans: pushdown, pruning, group limits, no nested-loop joins."""

import pytest
from pyspark.sql import functions as F

from sensorframe.catalog import all_queries
from sensorframe.catalog.base import Inputs
from sensorframe.operators import filters as L, windows as W
from sensorframe.plans.skew import is_large, plan_bytes

PATH = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, PATH)


def test_time_filter_reaches_the_scan(inputs):
    as_of = F.expr("TIMESTAMP_NTZ '2024-01-15 10:00:30'")
    text = plan(L.completed_minutes(inputs.table("events"), "ts", as_of, 60, 1).select("event_id"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_flow_join_reads_only_its_columns(spark):
    text = plan(all_queries()["joi01_pair_stages"].run(spark, PATH))
    assert "l_extendedprice" not in text and "l_tax" not in text


def test_sliding_log_limits_before_the_shuffle(inputs):
    text = plan(W.sliding_log(inputs.metrics.select("device", "seq", "value"), ["device"], ["seq"], 20))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_latest_combines_before_the_shuffle(spark):
    text = plan(all_queries()["agg29_latest"].run(spark, PATH))
    assert text.count("Aggregate") >= 2 and "partial_max_by" in text


def test_windows_of_one_series_share_a_shuffle(inputs):
    df = inputs.metrics.select("device", "seq", "k", "timestamp", "ivalue")
    text = plan(W.difference_positive(df, ["device"], "timestamp", "ivalue", ["k", "seq"]))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1


def test_size_estimate_is_not_multiplied_by_joins(inputs):
    orders, lines = inputs.table("orders"), inputs.table("lineitem")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    assert plan_bytes(joined) < 10 * (plan_bytes(orders) + plan_bytes(lines))
    assert not is_large(joined)


WRITES = ("src", "snk", "str", "udf02", "win12", "agg2", "flt07", "flt08", "srt03", "agg09", "joi06_l", "prj17")


@pytest.mark.parametrize("name", [n for n in sorted(all_queries()) if not n.startswith(WRITES)])
def test_no_cross_or_nested_loop_joins(spark, name):
    text = plan(all_queries()[name].run(spark, PATH))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
