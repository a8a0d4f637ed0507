import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.operators import reconcile as R

names = st.lists(st.sampled_from(["a", "b", "c", "d", "e", "f"]), unique=True, max_size=6)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(declared=names, deployed=names)
def test_obsolete_new_matching_partition_the_names(spark, declared, deployed):
    dec = spark.createDataFrame([("cat", "sch", n, None) for n in declared],
                                "target_catalog_name string, target_schema_name string, name string, pipeline_id string")
    dep = spark.createDataFrame([(n, f"id-{n}") for n in deployed], "name string, pipeline_id string")
    obs = {r.name for r in R.obsolete(dep, dec).collect()}
    new = {r.name for r in R.new(dec, dep).collect()}
    match = {r.name: r.pipeline_id for r in R.matching(dec, dep).collect()}
    assert obs == set(deployed) - set(declared)
    assert new == set(declared) - set(deployed)
    assert match == {n: f"id-{n}" for n in set(declared) & set(deployed)}
    plan = {r.name: r.action for r in R.deploy_plan(dec, dep).collect()}
    assert plan == {**{n: "delete" for n in obs}, **{n: "create" for n in new}, **{n: "update" for n in match}}
    safe = {r.name for r in R.deploy_plan(dec, dep, destructive=False).collect()}
    assert safe == set(declared)


def test_repeated_deployed_names_last_wins(spark):
    dep = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 1)], "name string, pipeline_id string, pos int")
    dec = spark.createDataFrame([("c", "s", "a", None)], "target_catalog_name string, target_schema_name string, name string, pipeline_id string")
    assert [tuple(r) for r in R.matching(dec, dep, order="pos").collect()] == [("c", "s", "a", "2")]


def test_or_semi_join_equals_nested_loop(spark):
    jobs = spark.createDataFrame([("j1", "p1", 1), ("j2", "p9", 2), ("x", "p2", 3), ("y", None, 4)],
                                 "name string, pipeline_id string, job_id int")
    obsolete = spark.createDataFrame([("j1", "p2"), ("j1", "p1"), ("z", None)], "name string, pipeline_id string")
    got = R.or_semi_join(jobs, obsolete.select(F.col("name").alias("n"), F.col("pipeline_id").alias("p")),
                         [("name", "n"), ("pipeline_id", "p")])
    expect = jobs.alias("j").join(obsolete.alias("o"), (F.col("j.name") == F.col("o.name")) |
                                  (F.col("j.pipeline_id") == F.col("o.pipeline_id")), "left_semi")
    assert sorted(r.job_id for r in got.collect()) == sorted(r.job_id for r in expect.collect()) == [1, 3]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_lookup_first_and_last(spark):
    t = spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], "name string, pipeline_id string, pos int")
    left = spark.createDataFrame([("a",), ("missing",)], "name string")
    first = {r.name: r.pipeline_id for r in R.lookup(left, t, "name", "pipeline_id", "pos").collect()}
    last = {r.name: r.pipeline_id for r in R.lookup(left, t, "name", "pipeline_id", "pos", first=False).collect()}
    assert first == {"a": "1", "missing": None}
    assert last == {"a": "2", "missing": None}


def test_top1_and_empty_raises(spark):
    nodes = spark.createDataFrame(
        [("big", 8, 32000, 0, False), ("small", 4, 16000, 0, False), ("hidden", 2, 8000, 0, True),
         ("tie", 4, 16000, 0, False)],
        "node_type_id string, num_cores int, memory_mb int, num_gpus int, is_hidden boolean")
    top = R.top1(nodes, ~F.col("is_hidden"), ["num_cores", "memory_mb", "num_gpus", "node_type_id"])
    assert R.require_one(top, "none").node_type_id == "small"
    with pytest.raises(RuntimeError):
        R.require_one(R.top1(nodes, F.col("num_cores") > 100, ["num_cores"]), "no eligible node type")


def test_inventory_from_empty_tables(spark):
    empty = spark.createDataFrame([], "target_catalog_name string, target_schema_name string, pipeline_name string")
    inv = R.inventory(spark, empty, empty)
    assert inv.columns == ["target_catalog_name", "target_schema_name", "name", "pipeline_id"]
    assert inv.count() == 0


def test_deployed_jobs_from_listing(spark):
    listing = spark.createDataFrame(
        [(1, ("a", [("t", ("p1",))])), (2, ("b", [])), (3, ("c", [("t", None)])), (4, ("d", None))],
        "job_id int, settings struct<name:string, tasks:array<struct<task_key:string, pipeline_task:struct<pipeline_id:string>>>>")
    got = sorted(tuple(r) for r in R.deployed_jobs(listing).collect())
    assert got == [("a", 1, "p1"), ("c", 3, None)]
    other = sorted(tuple(r) for r in R.deployed_jobs(listing, task_field="pipeline_job").collect())
    assert other == [("a", 1, None), ("c", 3, None)]
    obsolete = spark.createDataFrame([("c", None), ("zzz", "p1")], "name string, pipeline_id string")
    assert sorted(r.job_id for r in R.jobs_of_obsolete_pipelines(R.deployed_jobs(listing), obsolete).collect()) == [1, 3]


def test_build_deploy_plan_end_to_end(spark):
    from sluice.model import stage_frame
    from sluice.plans.deploy import build_deploy_plan
    src = stage_frame(spark, "sources", [("c", "s", "p_new", "o", "parquet", "t", None, None),
                                         ("c", "s", "p_keep", "o", "parquet", "t", None, None)])
    tr = stage_frame(spark, "transformations", [])
    dst = stage_frame(spark, "destinations", [])
    dep_p = spark.createDataFrame([("p_keep", "id1"), ("p_gone", "id2")], "name string, pipeline_id string")
    dep_j = spark.createDataFrame([("p_keep", 10, "id1"), ("p_keep", 11, "id1"), ("other", 12, "id2"),
                                   ("p_gone", 13, None)], "job_name string, job_id int, pipeline_id string")
    plan = build_deploy_plan(spark, src, tr, dst, dep_p, dep_j)
    assert sorted((tuple(r)[2:] for r in plan.pipelines.collect()), key=repr) == [
        ("p_gone", "id2", "delete"), ("p_keep", "id1", "update"), ("p_new", None, "create")]
    assert {tuple(r)[:2] for r in plan.pipelines.collect() if r.action != "delete"} == {("c", "s")}
    assert sorted(tuple(r) for r in plan.jobs.collect()) == [
        ("other", 12, "id2", "delete"), ("p_gone", 13, None, "delete"),
        ("p_keep", 10, "id1", "update"), ("p_new", None, None, "create")]
    safe = build_deploy_plan(spark, src, tr, dst, dep_p, dep_j, destructive=False)
    assert {r.action for r in safe.jobs.collect()} == {"create", "update"}


def test_repeated_deployments_update_the_last_and_delete_all(spark):
    from sluice.model import stage_frame
    from sluice.plans.deploy import build_deploy_plan
    src = stage_frame(spark, "sources", [("c", "s", "p", "o", "parquet", "t", None, None)])
    none = [stage_frame(spark, s, []) for s in ("transformations", "destinations")]
    pipelines = spark.createDataFrame([("p", "9"), ("p", "10"), ("gone", "x"), ("gone", "y")], "name string, pipeline_id string").coalesce(1)
    jobs = spark.createDataFrame([("p", "9", "9"), ("p", "10", "10")], "job_name string, job_id string, pipeline_id string").coalesce(1)
    plan = build_deploy_plan(spark, src, *none, pipelines, jobs)
    assert sorted(tuple(r)[2:] for r in plan.pipelines.collect()) == [("gone", "x", "delete"), ("gone", "y", "delete"), ("p", "10", "update")]
    assert [tuple(r) for r in plan.jobs.collect()] == [("p", "9", "10", "update")]
    safe = R.deploy_plan(R.inventory(spark, src), pipelines, destructive=False)
    assert "FullOuter" not in safe._jdf.queryExecution().optimizedPlan().toString()
