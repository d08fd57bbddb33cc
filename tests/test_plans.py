"""Shapes of physical plans that must hold at any size."""

import re

import pytest

from braidwork.plans import core, extensions  # noqa: F401

SF = "/root/testdata/sf0.001"
#: One row on either side.
CROSSED = {"state_snapshot", "ext_leaving_check"}
#: Settled streams and trees run while they are built.
EAGER = {n for n in core.QUERIES if n.startswith("stream_")} | {"span_tree"}


def plan(spark, name):
    return core.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - EAGER - CROSSED))
def test_no_cross_join(spark, name):
    got = plan(spark, name)
    assert "CartesianProduct" not in got and "BroadcastNestedLoopJoin" not in got


@pytest.mark.parametrize("name", ["safety_check", "safety_blocked", "tool_text", "tool_schema", "chunk_sections", "args_parse", "span_duration", "tool_failures", "result_preview", "vector_norms"])
def test_narrow_queries_do_not_shuffle(spark, name):
    got = plan(spark, name)
    assert "Exchange" not in got and "Python" not in got


@pytest.mark.parametrize(("name", "columns"), [("state_targets", {"event_id", "ts", "user_id", "value"}), ("turn_tools", {"conv_id", "turn", "role"}), ("registry_size", {"p_partkey", "p_name", "p_brand", "p_type", "p_size"})])
def test_scans_read_the_columns_they_need(spark, name, columns):
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan(spark, name)).group(1)
    assert {c.split(":")[0] for c in read.split(",")} <= columns


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [In(role" in plan(spark, "memory_history")


def test_last_write_is_combined_before_the_shuffle(spark):
    got = plan(spark, "state_targets")
    assert got.count("Aggregate") >= 2 and "partial_max_by" in got
