from sluice.__main__ import main


def test_cli_ingest_run_plan(spark, config_root, scratch):
    good = config_root("good")
    assert main(["ingest", good, "--database", "sluice_cli", "--dry-run"]) == 0
    assert main(["ingest", good, "--database", "sluice_cli"]) == 0
    assert spark.table("sluice_cli.transformations").count() > 0
    assert main(["run", "event_flow", "--database", "sluice_cli"]) == 0
    spark.createDataFrame([("orders_flow", "id-1"), ("gone", "id-2")], "name string, pipeline_id string") \
        .write.parquet(f"{scratch}/deployed")
    assert main(["plan", "--database", "sluice_cli", "--deployed", f"{scratch}/deployed", "--out", f"{scratch}/plan"]) == 0
    actions = {r.name: r.action for r in spark.read.parquet(f"{scratch}/plan/pipelines").collect()}
    assert actions == {"orders_flow": "update", "event_flow": "create", "gone": "delete"}


def test_cli_ingest_reports_problems(config_root):
    assert main(["ingest", config_root("broken"), "--dry-run"]) == 1
