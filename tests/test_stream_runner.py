"""Streaming plans of declared pipelines: relation scope, running aggregates, several sources, tables, replays and refreshes."""

import pytest
from pyspark.sql import functions as F

from sluice.plans.plan_tree import group_columns, relations_read, stateful_nodes
from sluice.plans.runner import PipelineRun, PipelineSpec
from sluice.plans.stream_runner import UnsupportedStream, run_stream
from sluice.sinks import batches, tables
from sluice.sinks.audits import read_counts
from sluice.sinks.upsert_store import UpsertStore


@pytest.mark.parametrize("sql, names", [
    ("WITH mid AS (SELECT * FROM a) SELECT * FROM mid", {"a"}),
    ("WITH a AS (SELECT * FROM a) SELECT * FROM a JOIN B", {"a", "b"}),
    ("SELECT * FROM x WHERE k IN (WITH x AS (SELECT 1 k) SELECT k FROM x) AND EXISTS (SELECT 1 FROM y.z)", {"x", "y.z"}),
    ("WITH p AS (WITH q AS (SELECT * FROM r) SELECT * FROM q), s AS (SELECT * FROM p JOIN q) SELECT (SELECT max(k) FROM t) FROM s", {"r", "q", "t"}),
    ("WITH RECURSIVE n AS (SELECT 1 AS i UNION ALL SELECT i + 1 FROM n WHERE i < 5) SELECT * FROM n, `Odd Name`", {"odd name"}),
    ("SELECT * FROM s, LATERAL (SELECT * FROM u WHERE u.k = s.k)", {"s", "u"}),
    ("VALUES (1)", set()),
])
def test_relations_read(spark, sql, names):
    assert relations_read(spark, sql) == names


def _files(spark, root, parts):
    """One file per part of (k, g, x) rows, read one by one."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "k long, g string, x double").coalesce(1).write.mode("append").parquet(f"{root}/in")
    return {"origin": f"{root}/in", "datatype": "parquet", "target": "s", "params": {"maxFilesPerTrigger": 1}}


PARTS = [[(1, "a", 1.0), (2, "b", 5.0)], [(3, "a", 3.0)], [(4, "c", 2.0), (5, "a", 8.0), (6, "b", 1.0)]]
STATS = {"origin": "s", "target": "stats", "sql_query": "SELECT g AS grp, count(*) AS n, sum(x) AS total, min(x) AS low FROM s GROUP BY g"}


def _stats_to(root, **more):
    return {"origin": "stats", "target": "out", "mode": "upsert", "path": f"{root}/out", "keys": ["grp"], "sequence_by": "low", **more}


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_running_aggregate_equals_batch_whatever_the_sequence(spark, scratch):
    # ``low`` falls as batches come in: the last update of a group must win all the same
    spec = PipelineSpec([_files(spark, scratch, PARTS)], [STATS], [_stats_to(scratch)])
    run_stream(spark, spec, f"{scratch}/chk").awaitTermination()
    _files(spark, scratch, [[(7, "c", 0.5), (8, None, 4.0)]])
    run_stream(spark, spec, f"{scratch}/chk").awaitTermination()
    store = UpsertStore(spark, f"{scratch}/out", ["grp"], "low")
    want = PipelineRun(spark, spec).run(write=False).relations["stats"]
    key = lambda r: (r[0] is None, r[0] or "")
    assert sorted(map(tuple, store.read().select("grp", "n", "total", "low").collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    store.compact()
    assert store.read().count() == want.count()


@pytest.mark.parametrize("stage, dest, message", [
    ("SELECT g, avg(x) AS m FROM s GROUP BY g", {"mode": "append"}, "append mode"),
    ("SELECT g, k, avg(x) AS m FROM s GROUP BY g, k", {"mode": "upsert", "keys": ["g"], "sequence_by": "m"}, "group columns"),
    ("SELECT max(x) AS m FROM s", {"mode": "upsert", "keys": ["m"], "sequence_by": "m"}, "group columns"),
    ("SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) AS r FROM s", {"mode": "append"}, "append mode"),
    ("SELECT g, count(*) AS n FROM (SELECT g, k, count(*) FROM s GROUP BY g, k) GROUP BY g", {"mode": "upsert", "keys": ["g"], "sequence_by": "n"},
     "update mode"),
    ("SELECT 1 AS one", {"mode": "append"}, None),
])
def test_what_a_stream_cannot_do_is_refused_before_it_starts(spark, scratch, stage, dest, message):
    spec = PipelineSpec([_files(spark, scratch, PARTS[:1])], [{"origin": "s", "target": "t", "sql_query": stage}],
                        [{"origin": "t", "target": "out", "path": f"{scratch}/out", **dest}])
    if message is None:  # per-batch stages may read no stream; a streaming plan's may not
        spec.sources.append({**spec.sources[0], "target": "s2"})
        message = "no streamed source"
    with pytest.raises(UnsupportedStream, match=message):
        run_stream(spark, spec, f"{scratch}/chk", stream_target="*")
    assert not batches.path_exists(spark, f"{scratch}/chk") and not batches.path_exists(spark, f"{scratch}/out")


def test_watermarked_windows_append_once(spark, scratch):
    rows = spark.range(60).select("id", F.timestamp_seconds("id").alias("ts"))
    for lo in (0, 30):
        rows.filter(f"id BETWEEN {lo} AND {lo + 29}").coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    spec = PipelineSpec([{"origin": f"{scratch}/in", "datatype": "parquet", "target": "s", "params": {"maxFilesPerTrigger": 1, "watermark": "ts 5 seconds"}}],
                        [{"origin": "s", "target": "w", "sql_query": "SELECT window.start AS at, count(*) AS n FROM s GROUP BY window(ts, '10 seconds')"}],
                        [{"origin": "w", "target": "out", "mode": "append", "path": f"{scratch}/out"}])
    run_stream(spark, spec, f"{scratch}/chk").awaitTermination()
    got = [r.n for r in batches.read_batches(spark, f"{scratch}/out").orderBy("at").collect()]
    assert got and set(got) == {10} and len(got) >= 4  # windows that the watermark has not passed stay in the state


def test_two_streams_union_and_join_with_a_static_relation(spark, scratch):
    one = _files(spark, f"{scratch}/1", PARTS)
    two = {**_files(spark, f"{scratch}/2", [[(10, "a", 1.0)], [(11, "z", 2.0)]]), "target": "s2"}
    spark.createDataFrame([("a", "A"), ("z", "Z")], "g string, name string").write.parquet(f"{scratch}/names")
    spec = PipelineSpec([one, two, {"origin": f"{scratch}/names", "datatype": "parquet", "target": "names"}],
                        [{"origin": "s", "target": "u", "sql_query": "SELECT k, name FROM (SELECT * FROM s UNION ALL SELECT * FROM s2) JOIN names USING (g)"}],
                        [{"origin": "u", "target": "out", "mode": "append", "path": f"{scratch}/out"},
                         {"origin": "u", "target": "latest", "mode": "upsert", "path": f"{scratch}/latest", "keys": ["name"], "sequence_by": "k"}])
    run_stream(spark, spec, f"{scratch}/chk", stream_target=["s", "s2"]).awaitTermination()
    assert _rows(batches.read_batches(spark, f"{scratch}/out")) == [(1, "A"), (3, "A"), (5, "A"), (10, "A"), (11, "Z")]
    assert _rows(UpsertStore(spark, f"{scratch}/latest", ["name"], "k").read()) == [(10, "A"), (11, "Z")]
    with pytest.raises(UnsupportedStream, match="no such source"):
        run_stream(spark, spec, f"{scratch}/chk", stream_target="nope")


def test_fail_rule_stops_a_streaming_plan(spark, scratch):
    source = {**_files(spark, scratch, PARTS), "validations": [{"validation_rule": "x < 8", "validation_action": "FAIL"},
                                                               {"validation_rule": "x < 2", "validation_action": "DROP"}]}
    spec = PipelineSpec([source], [STATS], [_stats_to(scratch)])
    with pytest.raises(Exception, match="validation failed in stage 's'"):
        run_stream(spark, spec, f"{scratch}/chk").awaitTermination()
    with pytest.raises(UnsupportedStream, match="rule counts"):
        run_stream(spark, spec, f"{scratch}/chk2", audit_path=f"{scratch}/audit")


def test_counts_of_a_failing_micro_batch_are_kept(spark, scratch):
    source = {**_files(spark, scratch, [[(1, "a", 1.0), (2, "a", 9.0)]]), "validations": [{"validation_rule": "x < 8", "validation_action": "FAIL"}]}
    spec = PipelineSpec([source], [], [{"origin": "s", "target": "out", "mode": "append", "path": f"{scratch}/out"}])
    with pytest.raises(Exception, match="validation failed"):
        run_stream(spark, spec, f"{scratch}/chk", audit_path=f"{scratch}/audit").awaitTermination()
    assert [(r.checked, r.violations) for r in read_counts(spark, f"{scratch}/audit").collect()] == [(2, 1)]


def test_table_destination_of_a_stream(spark, scratch):
    db = "sluice_t" + str(abs(hash(scratch)))
    dest = {"origin": "s", "target": "t", "mode": "append", "target_schema_name": db}
    spec = PipelineSpec([_files(spark, scratch, PARTS)], [], [dest])
    run_stream(spark, spec, f"{scratch}/chk").awaitTermination()
    more = spark.createDataFrame([(9, "n", 1.0, True)], "k long, g string, x double, more boolean")
    tables.write_destination(more, dest)                                        # a batch run adds rows and a column
    name = tables.destination_table(spark, dest)
    assert spark.table(name).columns == ["k", "g", "x", "more"] and spark.table(name).count() == 7
    tables.append_batch(more.limit(0), name, "w", 0)
    tables.append_batch(more, name, "w", 1)
    tables.append_batch(more, name, "w", 1)                                     # a replay adds nothing
    assert spark.table(name).count() == 8
    tables.append_batch(more.limit(0), name, "w", 1)                            # and one without rows takes them back
    assert spark.table(name).count() == 7
    with pytest.raises(batches.SchemaMismatch):
        tables.append_batch(spark.createDataFrame([("x",)], "k string"), name, "w", 2)
    run_stream(spark, spec, f"{scratch}/chk", full_refresh=True).awaitTermination()
    assert spark.table(name).columns == ["k", "g", "x"] and sorted(r.k for r in spark.table(name).collect()) == [1, 2, 3, 4, 5, 6]
    tables.write_destination(more, dest, full_refresh=True)
    assert _rows(spark.table(name)) == [(9, "n", 1.0, True)]
    assert len([t for t in spark.catalog.listTables(db) if "__rows_" in t.name]) == 1
    spark.sql(f"CREATE TABLE {db}.plain AS SELECT 1 AS k")
    spec.destinations[0] = {**dest, "target": "plain"}
    with pytest.raises(ValueError, match="made elsewhere"):
        run_stream(spark, spec, f"{scratch}/chk3")


def test_a_replay_keeps_its_first_arrival(spark, scratch):
    store = UpsertStore(spark, f"{scratch}/u", ["k"], "seq")
    for writer in "aba":
        store.merge(spark.createDataFrame([(1, 5, writer)], "k long, seq long, w string"), f"stream-{writer}", 0)
    assert store.read().first().w == "b"
    store.merge(spark.createDataFrame([(1, 5, "c")], "k long, seq long, w string"), "stream-c", 0, arrived=1)
    assert store.read().first().w == "b"


def test_batch_time_is_that_of_the_offset_log(spark, scratch):
    spec = PipelineSpec([_files(spark, scratch, PARTS)], [], [{"origin": "s", "target": "out", "mode": "append", "path": f"{scratch}/out"}])
    run_stream(spark, spec, f"{scratch}/chk").awaitTermination()
    times = [batches.batch_time(spark, f"{scratch}/chk", i) for i in range(3)]
    assert times == sorted(times) and len(set(times)) == 3


def _refreshed(spark, scratch, rule):
    source = {**_files(spark, scratch, PARTS), "validations": [rule] if rule else []}
    return PipelineSpec([source], [STATS], [{"origin": "s", "target": "all", "mode": "append", "path": f"{scratch}/all"},
                                            _stats_to(scratch)])


def test_a_refresh_replaces_all_destinations_or_none(spark, scratch):
    spec = _refreshed(spark, scratch, None)
    run_stream(spark, spec, f"{scratch}/chk").awaitTermination()

    def seen():
        return (_rows(batches.read_batches(spark, f"{scratch}/all").select("k")),
                _rows(UpsertStore(spark, f"{scratch}/out", ["grp"], "low").read().select("grp", "n")))

    before = seen()
    assert before == ([(k,) for k in range(1, 7)], [("a", 3), ("b", 2), ("c", 1)])
    spec.sources[0]["validations"] = [{"validation_rule": "k < 4", "validation_action": "FAIL"}]
    with pytest.raises(Exception, match="validation failed"):
        run_stream(spark, spec, f"{scratch}/chk", full_refresh=True).awaitTermination()
    assert seen() == before
    spec.sources[0]["validations"] = [{"validation_rule": "g <> 'b'", "validation_action": "DROP"}]
    run_stream(spark, spec, f"{scratch}/chk", full_refresh=True).awaitTermination()
    assert seen() == ([(1,), (3,), (4,), (5,)], [("a", 3), ("c", 1)])
    _files(spark, scratch, [[(20, "c", 9.0)]])
    run_stream(spark, spec, f"{scratch}/chk").awaitTermination()               # goes on from the refreshed state
    assert seen() == ([(1,), (3,), (4,), (5,), (20,)], [("a", 3), ("c", 2)])


@pytest.mark.parametrize("lost_at", range(1, 12))
def test_a_switch_lost_at_any_step_shows_old_or_new_rows(spark, scratch, monkeypatch, lost_at):
    frame = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    path = f"{scratch}/p"
    batches.write_batch(frame(1, 2), path, "w1")
    batches.write_batch(frame(3), path, "w2")
    batches.start_refresh(spark, path)
    batches.write_batch(spark.createDataFrame([("7",)], "k string"), f"{path}/_refresh", "w3")  # another type, too

    class Lost(Exception):
        pass

    steps = [0]

    def breaking(fn):
        def call(*args):
            steps[0] += 1
            if steps[0] == lost_at:
                raise Lost
            return fn(*args)
        return call

    with monkeypatch.context() as m:
        m.setattr(batches, "rename", breaking(batches.rename))
        m.setattr(batches, "delete_path", breaking(batches.delete_path))
        try:
            batches.switch(spark, path, "w3")
        except Lost:
            pass
    assert _rows(batches.read_batches(spark, path)) in ([(1,), (2,), (3,)], [("7",)])
    batches.switch(spark, path, "w3")
    assert _rows(batches.read_batches(spark, path)) == [("7",)]
    assert not batches.path_exists(spark, f"{path}/_switch") and not batches.path_exists(spark, f"{path}/_refresh")


def test_state_and_group_columns(spark, scratch):
    spark.readStream.schema("k long, g string, ts timestamp").parquet(scratch).createOrReplaceTempView("st_state")
    def look(q):
        df = spark.sql(q)
        return stateful_nodes(df), group_columns(df)
    assert look("SELECT * FROM st_state ORDER BY k") == ([], None)
    assert look("SELECT a, grp FROM (SELECT g AS grp, g AS g2, max(k) a FROM st_state GROUP BY g HAVING count(*) > 0)") == (["Aggregate"], [{"grp"}])
    assert look("SELECT window.start AS s, g, count(*) c FROM st_state GROUP BY window(ts, '5 seconds'), g") == (["Aggregate"], [{"s"}, {"g"}])
    assert look("SELECT a.k FROM st_state a JOIN st_state b ON a.k = b.k")[0] == ["Join"]
