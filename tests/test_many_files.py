"""Configuration trees of many folders: bounded driver calls and tasks, work dealt over tasks, and the rows that Spark's reader gives."""

import os
import pathlib
import uuid

import pytest
from pyspark.sql import functions as F

from sluice.plans.ingest import load_configs
from sluice.sinks import batches
from sluice.sources import configs, settings
from sluice.sources.configs import list_config_files
from sluice.sources.settings import load_settings


def _put(root, name, text=b"{}"):
    path = pathlib.Path(root, "pipelines", name)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def _tree(root, flows):
    """Pipelines of one schema, each with a column map of its own, a missing one and a settings file."""
    for i in range(flows):
        _put(root, f"c/s/f{i}/f.json", """{"transformations": [{"origin": "a", "target": "t", "config": "m.csv"},
                                                               {"origin": "a", "target": "u", "config": "gone.sql"}]}""")
        _put(root, f"c/s/f{i}/m.csv", f"source_column_name,dest_column_name\na{i},b{i}\n")
        _put(root, f"c/s/f{i}/_pipeline_settings.json", '{"continuous": "true"}')
    return str(root)


def _tasks(spark, work):
    """(what the work returns, tasks of every stage that it ran)"""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "")
    try:
        got = work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return got, [tracker.getStageInfo(s).numTasks for s in sorted(stages) if tracker.getStageInfo(s)]


def _driver_calls(monkeypatch, work):
    calls, real = [], batches._fs
    with monkeypatch.context() as m:
        m.setattr(batches, "_fs", lambda spark, path: (calls.append(path), real(spark, path))[1])
        return work(), len(calls)


def test_referenced_files_cost_the_driver_no_calls(spark, tmp_path, monkeypatch):
    roots = {n: _tree(tmp_path / str(n), n) for n in (2, 30)}
    (few, a), (many, b) = (_driver_calls(monkeypatch, lambda n=n: load_configs(spark, roots[n])) for n in (2, 30))
    assert a == b
    assert many.transformations.count() == 30
    assert {r.kind: r["count"] for r in many.problems.groupBy("kind").count().collect()} == {"missing_config_file": 30}


def test_settings_files_cost_the_driver_no_calls(spark, tmp_path, monkeypatch):
    roots = {n: _tree(tmp_path / str(n), n) for n in (2, 30)}
    (_, a), ((modes, _), b) = (_driver_calls(monkeypatch, lambda n=n: load_settings(spark, roots[n])) for n in (2, 30))
    assert a == b
    assert modes.filter("continuous").count() == 30


def test_folders_do_not_become_tasks(spark, tmp_path):
    roots = {n: _tree(tmp_path / str(n), n) for n in (10, 120)}
    (_, few), (found, many) = (_tasks(spark, lambda n=n: list_config_files(spark, roots[n]).count()) for n in (10, 120))
    assert found == 120
    assert sum(many) <= sum(few) + 10


def test_definition_files_are_written_by_many_tasks(spark, tmp_path):
    from sluice import queries
    flows = spark.range(900).coalesce(1).select(F.lit("c").alias("c"), F.lit("s").alias("s"), F.col("id").cast("string").alias("p"))
    documents = queries._documents(flows.unionByName(flows.filter("p = '7'")), sources="array(named_struct('origin', p, 'target', null))")
    _, tasks = _tasks(spark, lambda: queries._definitions(documents, str(tmp_path)))
    assert tasks[-1] >= 4
    at = lambda p: pathlib.Path(tmp_path, f"pipelines/c=c/s=s/p={p}/definition.json").read_text()
    assert len(list(tmp_path.glob("pipelines/*/*/*/*.json"))) == 900
    assert at(8) == '{"sources":[{"origin":"8"}]}\n' and at(7) == '{"sources":[{"origin":"7"}]}\n' * 2


@pytest.fixture
def odd_root(tmp_path):
    root = tmp_path / "odd root+%20"
    for name in ("a/b/c/x.json", "a/b/c/_y.json", "a/b/c/.z.json", "a/b/c/_q=1.json", "a/b/c/A.JSON", "a/b/c/w.json._COPYING_", "_h/b/c/x.json",
                 ".h/b/c/x.json", "_k=1/b/c/x.yml", "a/b/d.json/e/f/g/x.yaml", "a/b/c/p%20q r[1].toml", "top.json", "a/b/c/_pipeline_settings.yml",
                 "_h/b/c/_pipeline_settings.json", "a/b/c/deep/_pipeline_settings.json", "a/_pipeline_settings.json"):
        _put(root, name)
    _put(root, "a/b/c/empty.json", b"")
    _put(root, "a/b/e/_pipeline_settings.json", b"")
    os.symlink(root / "pipelines/a/b/c", root / "pipelines/a/b/linked")
    os.symlink("/nowhere", root / "pipelines/a/b/c/dangling.json")
    return str(root)


def test_tasks_list_what_the_readers_list(spark, odd_root, monkeypatch):
    def seen(root):
        files = [tuple(r) for r in list_config_files(spark, root, with_content=True).collect()]
        modes, problems = load_settings(spark, root)
        return sorted(files), sorted(map(str, modes.collect())), sorted(map(str, problems.collect()))

    mine = seen(odd_root)
    assert seen(f"file://{odd_root}/") == mine
    assert len(mine[0]) == 9 and len(mine[1]) == 3 and [p.count("parse_error") for p in mine[2]] == [1]
    for module in (configs, settings):
        monkeypatch.setattr(module, "reachable", lambda top: False)
    assert seen(odd_root) == mine


def test_a_missing_root_is_an_error_and_an_empty_one_is_not(spark, tmp_path):
    (tmp_path / "empty" / "pipelines").mkdir(parents=True)
    assert load_configs(spark, str(tmp_path / "empty")).problems.collect() == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_configs(spark, str(tmp_path / "none"))


def test_a_store_that_tasks_cannot_open_is_left_to_the_reader(spark, tmp_path):
    (tmp_path / "m.csv").write_text("source_column_name\nx\n")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.t.link./in", f"file://{tmp_path}")
    refs = spark.createDataFrame([("viewfs://t/in/m.csv",), ("viewfs://t/in/gone.csv",), (f"{tmp_path}/m.csv",), (f"{tmp_path}/gone.csv",)], "config string")
    got = {r.config_path: (r.there, bytes(r.content or b"")) for r in configs.referenced_files(spark, refs).collect()}
    text = b"source_column_name\nx\n"
    assert got == {"viewfs://t/in/m.csv": (True, text), "viewfs://t/in/gone.csv": (False, b""), f"{tmp_path}/m.csv": (True, text), f"{tmp_path}/gone.csv": (False, b"")}
