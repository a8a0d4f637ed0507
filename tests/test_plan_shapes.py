"""Scale guards over the physical plans of every registered query (sf0.001)."""

import pytest

import __spark_entry__ as E
from conftest import SMALL

# queries whose body writes (sinks, streams); their returned frame is a plain re-read
_WRITERS = {"append_sink", "metadata_roundtrip", "upsert_persisted", "stream_append", "stream_upsert",
            "stream_declared"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - _WRITERS))
def test_no_cartesian_no_nested_loop_no_row_python(spark, name):
    plan = plan_of(E.queries()[name](spark, SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


@pytest.mark.parametrize("name", ["conflicting_rules", "duplicate_targets", "ambiguous_keys", "lookup_first",
                                  "lookup_last", "inventory", "validate_log", "sql_group_avg", "end_to_end"])
def test_aggregations_are_partial_before_the_shuffle(spark, name):
    plan = plan_of(E.queries()[name](spark, SMALL))
    # a partial (map-side) aggregate below the shuffle plus the final one above it
    assert plan.count("Aggregate(") >= 2, name


@pytest.mark.parametrize("name", ["upsert_batch", "upsert_out_of_order"])
def test_upsert_limits_each_key_before_the_shuffle(spark, name):
    plan = plan_of(E.queries()[name](spark, SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name,needle", [("validate_drop", "GreaterThan(l_discount,0.0)"),
                                         ("validate_multi", "Not(EqualTo(event_type,error))")])
def test_drop_rules_reach_the_parquet_scan(spark, name, needle):
    assert needle in plan_of(E.queries()[name](spark, SMALL))


def test_column_maps_prune_the_scan(spark):
    plan = plan_of(E.queries()["end_to_end"](spark, SMALL))
    assert "ReadSchema: struct<event_type:string,value:double>" in plan
