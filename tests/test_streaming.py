import pytest
from pyspark.sql import functions as F

from sluice.operators.mapping import ColumnSpec, apply_column_map
from sluice.operators.quality import Rule, ValidationFailed, drop_violations
from sluice.operators.upsert import upsert
from sluice.sinks import batches
from sluice.sinks.upsert_store import UpsertStore
from sluice.streaming.stream import append_stream, stream_source, trigger_for, upsert_stream
from conftest import SMALL


def test_trigger_choice():
    assert trigger_for(False) == {"availableNow": True}
    assert trigger_for("true", "5 seconds") == {"processingTime": "5 seconds"}
    assert trigger_for(None) == {"availableNow": True}


def _events(spark):
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    return stream_source(spark, SMALL, "parquet", {"pathGlobFilter": "events.parquet"}, schema=schema)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_append_equals_batch(spark, scratch):
    specs = [ColumnSpec("event_id"), ColumnSpec("event_type", "kind"), ColumnSpec("value", "amount")]
    rules = [Rule("amount > 2", "DROP")]
    q = append_stream(apply_column_map(_events(spark), specs), f"{scratch}/out", f"{scratch}/chk", rules)
    q.awaitTermination()
    batch = drop_violations(apply_column_map(spark.read.parquet(f"{SMALL}/events.parquet"), specs), rules)
    assert _rows(batches.read_batches(spark, f"{scratch}/out")) == _rows(batch)


def test_stream_upsert_equals_batch_and_restart_is_idempotent(spark, scratch):
    store = UpsertStore(spark, f"{scratch}/t", ["user_id"], "ts")
    upsert_stream(_events(spark), store, f"{scratch}/chk").awaitTermination()
    first = _rows(store.read())
    # restart on the same checkpoint: nothing new, nothing applied twice
    upsert_stream(_events(spark), store, f"{scratch}/chk").awaitTermination()
    assert _rows(store.read()) == first
    batch = upsert(None, spark.read.parquet(f"{SMALL}/events.parquet"), ["user_id"], "ts")
    assert first == _rows(batch.select(*store.read().columns))


def test_stream_fail_rule_stops_the_query(spark, scratch):
    q = append_stream(_events(spark), f"{scratch}/out", f"{scratch}/chk", [Rule("value < 0", "FAIL")])
    with pytest.raises(Exception) as info:
        q.awaitTermination()
    assert "validation failed" in str(info.value)


def _declared_stream_spec(scratch):
    from sluice.plans.runner import PipelineSpec
    return PipelineSpec(
        sources=[{"origin": SMALL, "datatype": "parquet", "target": "ev",
                  "params": '{"pathGlobFilter": "events.parquet"}'}],
        transformations=[
            {"origin": "ev", "target": "mapped", "column_order": 1, "source_column_name": "event_id"},
            {"origin": "ev", "target": "mapped", "column_order": 2, "source_column_name": "user_id"},
            {"origin": "ev", "target": "mapped", "column_order": 3, "source_column_name": "ts"},
            {"origin": "ev", "target": "mapped", "column_order": 4, "source_column_name": "value",
             "dest_column_name": "amount", "validations": [{"validation_rule": "amount >= 2", "validation_action": "DROP"}]},
            {"origin": "mapped", "target": "big", "sql_query": "SELECT * FROM mapped WHERE amount > 10"},
        ],
        destinations=[
            {"origin": "mapped", "target": "latest", "mode": "upsert", "path": f"{scratch}/latest",
             "keys": ["user_id"], "sequence_by": "ts"},
            {"origin": "big", "target": "big_out", "mode": "append", "path": f"{scratch}/big"},
        ])


def test_declared_pipeline_on_a_stream_equals_batch_and_survives_restart(spark, scratch):
    from sluice.plans.runner import PipelineRun, run_stream
    spec = _declared_stream_spec(scratch)
    run_stream(spark, spec, f"{scratch}/chk").awaitTermination()
    run_stream(spark, spec, f"{scratch}/chk").awaitTermination()      # restart: no new input
    batch = PipelineRun(spark, spec).run(write=False).relations
    latest = UpsertStore(spark, f"{scratch}/latest", ["user_id"], "ts").read()
    expect = upsert(None, batch["mapped"], ["user_id"], "ts")
    assert _rows(latest.select(*expect.columns)) == _rows(expect)
    big = batches.read_batches(spark, f"{scratch}/big")
    assert _rows(big) == _rows(batch["big"])
    # full refresh empties targets and checkpoint, then reprocesses everything once
    run_stream(spark, spec, f"{scratch}/chk", full_refresh=True).awaitTermination()
    big2 = batches.read_batches(spark, f"{scratch}/big")
    assert _rows(big2) == _rows(batch["big"])


def test_batch_full_refresh_replaces_rows(spark, scratch):
    from sluice.plans.runner import PipelineRun
    spec = _declared_stream_spec(scratch)
    spec.sources[0]["origin"] = f"{SMALL}/events.parquet"
    spec.sources[0]["params"] = None
    PipelineRun(spark, spec).run()
    PipelineRun(spark, spec).run()
    n_twice = batches.read_batches(spark, f"{scratch}/big").count()
    PipelineRun(spark, spec).run(full_refresh=True)
    assert batches.read_batches(spark, f"{scratch}/big").count() * 2 == n_twice


def test_checkpointed_fail_stage_computes_once(spark, scratch):
    from sluice.plans.runner import PipelineRun, PipelineSpec
    spec = PipelineSpec(
        sources=[{"origin": f"{SMALL}/orders.parquet", "datatype": "parquet", "target": "o",
                  "validations": [{"validation_rule": "o_totalprice > 0", "validation_action": "FAIL"}]}],
        destinations=[{"origin": "o", "target": "t", "mode": "append", "path": f"{scratch}/o"}])
    res = PipelineRun(spark, spec, checkpoint_failable=True).run()
    assert res.written == ["t"]
    assert "ExistingRDD" in res.relations["o"]._jdf.queryExecution().optimizedPlan().toString() or \
        "LogicalRDD" in res.relations["o"]._jdf.queryExecution().optimizedPlan().toString()
    assert batches.read_batches(spark, f"{scratch}/o").count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()


def test_stream_fail_rules_pass_and_write_once_per_batch(spark, scratch):
    q = append_stream(_events(spark), f"{scratch}/out", f"{scratch}/chk", [Rule("value >= 0", "FAIL")])
    q.awaitTermination()
    n = batches.read_batches(spark, f"{scratch}/out").count()
    assert n == spark.read.parquet(f"{SMALL}/events.parquet").count()
    # replaying batch 0 by hand replaces its folder instead of adding rows
    writer = batches.stream_writer(spark, f"{scratch}/chk", f"{scratch}/out")
    batches.write_batch(spark.read.parquet(f"{SMALL}/events.parquet"), f"{scratch}/out", writer, 0)
    assert batches.read_batches(spark, f"{scratch}/out").count() == n


def test_a_new_checkpoint_is_another_writer(spark, scratch):
    small = [Rule("value >= 5", "DROP")]
    append_stream(_events(spark), f"{scratch}/out", f"{scratch}/chk", small).awaitTermination()
    batches.delete_path(spark, f"{scratch}/chk")
    append_stream(_events(spark), f"{scratch}/out", f"{scratch}/chk").awaitTermination()
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    assert batches.read_batches(spark, f"{scratch}/out").count() == events.count() + events.filter("value >= 5").count()


def test_stream_audit_holds_each_micro_batch_once(spark, scratch):
    from sluice.plans.runner import run_stream
    from sluice.sinks.audits import read_counts
    spec = _declared_stream_spec(scratch)
    for _ in range(2):
        run_stream(spark, spec, f"{scratch}/chk", audit_path=f"{scratch}/audit").awaitTermination()
    rows = read_counts(spark, f"{scratch}/audit").collect()
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    assert sum(r.checked for r in rows) == events.count()
    assert sum(r.violations for r in rows) == events.filter("NOT coalesce(value >= 2, false)").count()
