"""Config folder -> metadata tables -> inventory -> a full pipeline run with sinks."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import reconcile as R
from sluice.operators.quality import ValidationFailed
from sluice.plans.ingest import ConfigProblems, load_configs, write_metadata
from sluice.plans.runner import PipelineRun, PipelineSpec, StageOrderError
from sluice.sinks import batches
from sluice.sinks.upsert_store import UpsertStore
from sluice.sources.configs import list_config_files
from conftest import SMALL


def test_discovery_skips_settings_and_reads_all_formats(spark, config_root):
    root = config_root("good")
    names = sorted(r.path.rsplit("/", 1)[1] for r in list_config_files(spark, root).collect())
    assert names == ["event_flow.yaml", "orders_flow.json"]


def test_good_folder_ingests_cleanly(spark, config_root):
    res = load_configs(spark, config_root("good"))
    assert res.problems.count() == 0
    tr = res.transformations
    assert tr.filter("pipeline_name = 'orders_flow' AND sql_query IS NULL").count() == 6
    bad_order = tr.filter("source_column_name = 'o_orderpriority'").first()
    assert bad_order.column_order is None                      # "x" is not a digit string
    rule = tr.filter("dest_column_name = 'order_id'").first().validations
    assert [tuple(v) for v in rule] == [("order_id IS NOT NULL", "DROP")]
    assert {r.column_order for r in tr.filter("sql_query IS NOT NULL").collect()} == {1}
    sql = tr.filter("target = 'vw__silver__events_hourly'").first().sql_query
    assert "GROUP BY kind, hour" in sql and sql.count("\n") >= 2  # whole file, not lines
    src = res.sources.filter("pipeline_name = 'orders_flow'").first()
    assert src.params == '{"mergeSchema":false}' and (src.target_catalog_name, src.target_schema_name) == ("main", "sales")
    dest = {r.target: r for r in res.destinations.collect()}
    assert dest["orders_latest"].path.endswith("/main/sales/orders_flow/out/orders_latest")
    assert dest["orders_by_status"].keys is None and dest["orders_by_status"].sequence_by is None


def test_broken_folder_reports_every_problem(spark, config_root):
    res = load_configs(spark, config_root("broken"))
    got = {(r.kind, r.detail) for r in res.problems.collect()}
    kinds = {k for k, _ in got}
    assert {"parse_error", "ambiguous_file", "no_stage", "bad_config_file", "duplicate_target",
            "invalid_source", "invalid_transformation", "invalid_destination"} <= kinds
    assert ("invalid_destination", "d1: bad_mode") in got
    assert ("invalid_destination", "d2: upsert_without_keys_or_sequence") in got
    assert ("invalid_destination", "d3: bad_validation_action") in got
    assert ("invalid_transformation", "neither: no_transformation") in got
    assert ("invalid_transformation", "both: mapping_and_sql") in got
    assert ("invalid_transformation", "badtype: bad_source_column_type") in got
    assert ("invalid_source", "same_target: conflicting_validations") in got
    with pytest.raises(ConfigProblems):
        write_metadata(spark, res, database="sluice_broken")


def test_metadata_tables_inventory_and_run(spark, config_root):
    res = load_configs(spark, config_root("good"))
    write_metadata(spark, res, database="sluice_meta")
    tables = {s: spark.table(f"sluice_meta.{s}") for s in ("sources", "transformations", "destinations")}
    inv = R.inventory(spark, *tables.values())
    assert sorted(r.name for r in inv.collect()) == ["event_flow", "orders_flow"]

    spec = PipelineSpec.from_tables(tables["sources"], tables["transformations"], tables["destinations"],
                                    "orders_flow", "sales", "main")
    result = PipelineRun(spark, spec).run(write=True)
    assert sorted(result.written) == ["orders_by_status", "orders_latest"]
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    by_status = result.relations["vw__gold__orders_by_status"]
    assert by_status.agg(F.sum("n")).first()[0] == orders.count()
    dest = {r.target: r for r in res.destinations.collect()}
    latest = UpsertStore(spark, dest["orders_latest"].path, ["customer"], "ordered_at").read()
    assert latest.count() == orders.select("o_custkey").distinct().count()
    appended = batches.read_batches(spark, dest["orders_by_status"].path)
    assert appended.count() == by_status.count()


def test_yaml_pipeline_orders_stages_by_what_sql_reads(spark, config_root):
    res = load_configs(spark, config_root("good"))
    spec = PipelineSpec(
        [r.asDict(recursive=True) for r in res.sources.filter("pipeline_name = 'event_flow'").collect()],
        [r.asDict(recursive=True) for r in res.transformations.filter("pipeline_name = 'event_flow'").collect()],
        [])
    rel = PipelineRun(spark, spec).run(write=False).relations
    busy = rel["vw__gold__busy_hours"]
    assert busy.filter("n < 2").count() == 0 and busy.count() > 0
    assert rel["vw__silver__events"].columns == ["event_id", "kind", "amount", "hour"]


def test_unorderable_stages_raise(spark):
    spec = PipelineSpec(transformations=[
        {"origin": "a", "target": "b", "sql_query": "SELECT * FROM nowhere_to_be_found"}])
    with pytest.raises(StageOrderError):
        PipelineRun(spark, spec).run(write=False)


def test_fail_rule_stops_before_any_write(spark, scratch):
    spec = PipelineSpec(
        sources=[{"origin": f"{SMALL}/orders.parquet", "datatype": "parquet", "target": "o",
                  "validations": [{"validation_rule": "o_totalprice > 1000000000", "validation_action": "FAIL"}]}],
        destinations=[{"origin": "o", "target": "t", "mode": "append", "path": f"{scratch}/never"}])
    with pytest.raises(ValidationFailed):
        PipelineRun(spark, spec).run(write=True)
    import os
    assert not os.path.exists(f"{scratch}/never")


def test_rule_counts_of_a_run(spark, scratch):
    spec = PipelineSpec(
        sources=[{"origin": f"{SMALL}/orders.parquet", "datatype": "parquet", "target": "o",
                  "validations": [{"validation_rule": "o_orderstatus = 'F'", "validation_action": "LOG"},
                                  {"validation_rule": "o_totalprice > 100000", "validation_action": "DROP"}]}],
        destinations=[{"origin": "o", "target": "t", "mode": "append", "path": f"{scratch}/o"}])
    run = PipelineRun(spark, spec)
    run.run()
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    counts = {r: (c, v) for r, _, c, v in run.counts["o"]}
    n = orders.count()
    assert counts["o_orderstatus = 'F'"] == (n, orders.filter("NOT (o_orderstatus = 'F')").count())
    assert counts["o_totalprice > 100000"] == (n, orders.filter("NOT (o_totalprice > 100000)").count())
    assert batches.read_batches(spark, f"{scratch}/o").count() == orders.filter("o_totalprice > 100000").count()


def test_shared_stage_is_persisted_and_audit_table_written(spark, scratch):
    spec = PipelineSpec(
        sources=[{"origin": f"{SMALL}/orders.parquet", "datatype": "parquet", "target": "o",
                  "validations": [{"validation_rule": "o_totalprice > 100000", "validation_action": "LOG"}]}],
        destinations=[{"origin": "o", "target": "a", "mode": "append", "path": f"{scratch}/a"},
                      {"origin": "o", "target": "b", "mode": "append", "path": f"{scratch}/b"}])
    run = PipelineRun(spark, spec)
    assert run.shared == {"o"}
    run.run()
    assert run.persisted == []                      # released after the writes
    run.write_audit(f"{scratch}/audit", run_id="r1")
    audit_rows = batches.read_batches(spark, f"{scratch}/audit").collect()
    n = spark.read.parquet(f"{SMALL}/orders.parquet").count()
    assert [(r.run_id, r.stage, r.action, r.checked) for r in audit_rows] == [("r1", "o", "LOG", n)]


def test_destination_without_path_goes_to_catalog_schema_database(spark):
    spec = PipelineSpec(
        sources=[{"origin": f"{SMALL}/region.parquet", "datatype": "parquet", "target": "r"}],
        destinations=[{"target_catalog_name": "main", "target_schema_name": "geo", "pipeline_name": "p",
                       "origin": "r", "target": "regions", "mode": "append"}])
    PipelineRun(spark, spec).run(full_refresh=True)
    PipelineRun(spark, spec).run()
    assert spark.table("main__geo.regions").count() == 2 * spark.read.parquet(f"{SMALL}/region.parquet").count()


def test_empty_column_map_read_leaves_the_shared_schema_alone(spark):
    from sluice.model import COLUMN_MAP_CSV
    from sluice.sources.configs import read_column_maps
    before = COLUMN_MAP_CSV.fieldNames()
    assert "config_path" in read_column_maps(spark, []).columns
    assert COLUMN_MAP_CSV.fieldNames() == before


def test_a_declared_stage_wins_over_a_catalog_table_of_its_name(spark, scratch):
    spark.createDataFrame([(999,)], "x int").write.mode("overwrite").option("path", f"{scratch}/stale").saveAsTable("stale_mid")
    spec = PipelineSpec(
        sources=[{"origin": f"{SMALL}/region.parquet", "datatype": "parquet", "target": "r"}],
        transformations=[
            {"origin": "stale_mid", "target": "last", "sql_query": "WITH c AS (SELECT max(x) AS x FROM Stale_Mid) SELECT (SELECT x FROM c) AS x"},
            {"origin": "stale_mid", "target": "mapped", "column_order": 1, "source_column_name": "x"},
            {"origin": "r", "target": "stale_mid", "sql_query": "SELECT 5 AS x FROM r"}])
    try:
        got = PipelineRun(spark, spec).run(write=False).relations
        assert [r.x for r in got["last"].collect()] == [5]
        assert {r.x for r in got["mapped"].collect()} == {5}
    finally:
        spark.sql("DROP TABLE stale_mid")


def test_a_chain_of_fail_stages_reads_its_source_once_and_filters_reach_the_scan(spark, scratch):
    reads = spark.sparkContext.accumulator(0)
    counted = spark.sparkContext.parallelize(range(20), 2).map(lambda i: (reads.add(1), (i,))[1])
    rows = spark.createDataFrame(counted, "x int")
    fail = [{"validation_rule": "x >= 0", "validation_action": "FAIL"}]
    spec = PipelineSpec(
        sources=[{"origin": "-", "datatype": "parquet", "target": "s0", "validations": fail}],
        transformations=[{"origin": f"s{i}", "target": f"s{i + 1}", "sql_query": f"SELECT x + 1 AS x FROM s{i}", "validations": fail}
                         for i in range(3)],
        destinations=[{"origin": "s3", "target": "t", "mode": "append", "path": f"{scratch}/t"}])
    PipelineRun(spark, spec, isolate=False, preloaded={"s0": rows}).run()
    assert reads.value == 20
    drop = PipelineSpec(
        sources=[{"origin": f"{SMALL}/orders.parquet", "datatype": "parquet", "target": "o",
                  "validations": [{"validation_rule": "o_totalprice > 100000", "validation_action": "DROP"}]}],
        destinations=[{"origin": "o", "target": "t", "mode": "append", "path": f"{scratch}/o"}])
    plan = PipelineRun(spark, drop).run().relations["t"]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100000" in plan


def _folder(tmp_path, files):
    base = tmp_path / "odd root" / "pipelines" / "cat" / "sch" / "flow+1"
    base.mkdir(parents=True)
    for name, text in files.items():
        (base / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path / "odd root")


def test_column_maps_with_quotes_breaks_and_short_headers(spark, tmp_path):
    doc = """{"transformations": [{"origin": "s", "target": "t", "config": "my map.csv"},
                                  {"origin": "t", "target": "u", "config": "q.sql"}]}"""
    cells = 'dest_column_name,transform_function,column_order\nfull,"concat(a, ""-x"",\n \'y\')",2\nb,upper(b),1\n'
    res = load_configs(spark, _folder(tmp_path, {"flow.json": doc, "my map.csv": cells, "q.sql": "SELECT 1\nFROM t"}))
    assert res.problems.collect() == []
    got = {r.dest_column_name: (r.transform_function, r.column_order) for r in res.transformations.filter("target = 't'").collect()}
    assert got == {"full": ("concat(a, \"-x\",\n 'y')", 2), "b": ("upper(b)", 1)}
    assert res.transformations.filter("target = 'u'").first().sql_query == "SELECT 1\nFROM t"


def test_missing_files_wrong_shapes_and_cross_row_conflicts_are_rows(spark, tmp_path):
    doc = """{"sources": {"origin": "a"},
              "transformations": [{"origin": "s", "target": "t", "config": "gone.csv"}, {"origin": "s", "target": "x", "config": "gone.sql"},
                                  {"origin": "s", "target": "m", "config": "clash.csv"}, {"origin": "s", "target": "w", "config": "wide.csv"},
                                  {"origin": 5, "target": "n", "source_column_name": "a", "column_order": 3}],
              "destinations": [{"origin": "m", "target": "d", "mode": "append", "keys": "id"}]}"""
    clash = "source_column_name,validation_rule,validation_action\na,x > 0,DROP\nb, x > 0 ,FAIL\nc,y > 0,LOG\nd,y > 0,LOG\n"
    res = load_configs(spark, _folder(tmp_path, {"flow.json": doc, "clash.csv": clash, "wide.csv": "source_column_name\na,b\n"}))
    got = sorted((r.kind, r.detail.rsplit("/", 1)[-1]) for r in res.problems.collect())
    assert ("missing_config_file", "gone.csv") in got and ("missing_config_file", "gone.sql") in got
    assert ("conflicting_rules", "m: x > 0: DROP,FAIL") in [(r.kind, r.detail) for r in res.problems.collect()]
    assert [d for k, d in got if k == "conflicting_rules"] == ["m: x > 0: DROP,FAIL"]
    assert sorted(d for k, d in got if k == "invalid_shape") == [
        "destinations[0].keys: expected a list, got str", "sources: expected a list, got dict",
        "transformations[4].origin: expected text, got int"]
    assert any(k == "bad_config_file" and d.startswith("wide.csv") for k, d in got)


def test_settings_files_decide_the_run_mode(spark, tmp_path):
    import pathlib

    from sluice.sources.settings import load_settings, run_mode
    from sluice.streaming.stream import trigger_for

    def put(where, text):
        path = pathlib.Path(tmp_path, "pipelines", *where.split("/"))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())

    put("c/s/on/_pipeline_settings.json", '{"name": "on", "continuous": "true", "clusters": [{"label": "x"}]}')
    put("c/s/off/_pipeline_settings.yaml", "continuous: false\n")
    put("c/s/none/_pipeline_settings.toml", 'name = "none"\n')
    put("c/s2/on/_pipeline_settings.json", '{"continuous": false}')
    put("c/s/twice/_pipeline_settings.json", "{}")
    put("c/s/twice/_pipeline_settings.yml", "{}")
    put("c/s/broken/_pipeline_settings.json", b"{\xff")
    put("c/s/odd/_pipeline_settings.json", '{"continuous": "perhaps"}')
    put("c/s/other/_job_settings.json", "not read")
    settings, problems = load_settings(spark, str(tmp_path))
    settings = settings.persist()
    assert run_mode(settings, "on", "s") and not run_mode(settings, "on", "s2", "c")
    assert not run_mode(settings, "off") and not run_mode(settings, "none") and not run_mode(settings, "missing")
    with pytest.raises(ValueError, match="differ"):
        run_mode(settings, "on")
    assert trigger_for(run_mode(settings, "on", "s")) == {"processingTime": "1 minute"}
    assert sorted((p.kind, p.path.split("/")[-2]) for p in problems.collect()) == [
        ("ambiguous_file", "twice"), ("invalid_settings", "odd"), ("parse_error", "broken")]
    assert load_settings(spark, f"{tmp_path}/nowhere")[0].count() == 0
