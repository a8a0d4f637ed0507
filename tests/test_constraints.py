"""Stage-row constraints (what the ingestion audit rejects), one case per rule."""

import pytest

from sluice.model import stage_frame
from sluice.operators.stages import stage_violations

ID = ("cat", "sch", "pipe")


def violations(spark, stage, row, strict=False):
    df = stage_frame(spark, stage, [row])
    return stage_violations(df, stage, strict).first().violations


def src(**kw):
    base = dict(zip(("target_catalog_name", "target_schema_name", "pipeline_name"), ID))
    base.update(origin="o", datatype="parquet", target="t", params=None, validations=None)
    base.update(kw)
    return base


def tr(**kw):
    base = dict(zip(("target_catalog_name", "target_schema_name", "pipeline_name"), ID))
    base.update(origin="o", target="t", column_order=1, source_column_name="a", source_column_type=None,
                dest_column_name="b", dest_column_type=None, transform_function=None, sql_query=None,
                default_value=None, validations=None)
    base.update(kw)
    return base


def dst(**kw):
    base = dict(zip(("target_catalog_name", "target_schema_name", "pipeline_name"), ID))
    base.update(origin="o", target="t", mode="append", path=None, keys=None, sequence_by=None, validations=None)
    base.update(kw)
    return base


def test_clean_rows_pass(spark):
    assert violations(spark, "sources", src()) == []
    assert violations(spark, "transformations", tr()) == []
    assert violations(spark, "destinations", dst(mode="upsert", keys=["k"], sequence_by="ts")) == []


@pytest.mark.parametrize("field", ["target_catalog_name", "target_schema_name", "pipeline_name"])
@pytest.mark.parametrize("value", ["", "   ", "　", None])
def test_identity_must_be_non_empty_after_strip(spark, field, value):
    assert f"empty_{field}" in violations(spark, "sources", src(**{field: value}))


@pytest.mark.parametrize("field", ["origin", "datatype", "target"])
def test_source_fields_required(spark, field):
    assert f"empty_{field}" in violations(spark, "sources", src(**{field: ""}))


@pytest.mark.parametrize("action,ok", [("LOG", True), ("DROP", True), ("FAIL", True), ("WARN", False),
                                       ("drop", False), ("", False)])
def test_validation_actions(spark, action, ok):
    v = violations(spark, "sources", src(validations=[("x > 0", action)]))
    assert ("bad_validation_action" not in v) == ok


def test_empty_rule_and_conflicts(spark):
    assert "empty_validation_rule" in violations(spark, "sources", src(validations=[("", "LOG")]))
    rules = [("x > 0", "LOG"), (" x > 0\n", "FAIL"), ("y", "LOG")]
    assert "conflicting_validations" in violations(spark, "destinations", dst(validations=rules))
    assert "conflicting_validations" not in violations(spark, "destinations", dst(validations=rules[1:]))


@pytest.mark.parametrize("name,ok", [(n, True) for n in
                                     ("string", "int", "double", "date", "timestamp", "boolean", "struct", "array", "map")]
                         + [("decimal", False), ("long", False), ("String", False), ("", False)])
def test_type_names(spark, name, ok):
    v = violations(spark, "transformations", tr(source_column_type=name, dest_column_type=name))
    assert ("bad_source_column_type" not in v) == ok and ("bad_dest_column_type" not in v) == ok


def test_column_order_at_least_one(spark):
    assert "column_order_below_1" in violations(spark, "transformations", tr(column_order=0))
    assert "column_order_below_1" not in violations(spark, "transformations", tr(column_order=None))


def test_mapping_xor_sql(spark):
    neither = tr(source_column_name=None, dest_column_name=None)
    assert "no_transformation" in violations(spark, "transformations", neither)
    both = tr(sql_query="SELECT 1")
    assert "mapping_and_sql" in violations(spark, "transformations", both)
    half = tr(dest_column_name=None, sql_query="SELECT 1")
    assert "mapping_and_sql" not in violations(spark, "transformations", half)          # default mode
    assert "mapping_and_sql" in violations(spark, "transformations", half, strict=True)  # strict mode
    sql_only = tr(source_column_name=None, dest_column_name=None, sql_query="SELECT 1")
    assert violations(spark, "transformations", sql_only) == []
    assert "empty_sql_query" in violations(spark, "transformations", tr(sql_query=""))


@pytest.mark.parametrize("mode,ok", [("append", True), ("upsert", True), ("merge", False), ("APPEND", False)])
def test_destination_modes(spark, mode, ok):
    v = violations(spark, "destinations", dst(mode=mode, keys=["k"], sequence_by="s"))
    assert ("bad_mode" not in v) == ok


@pytest.mark.parametrize("keys,seq", [(None, "s"), ([], "s"), (["k"], None), (["k"], "")])
def test_upsert_needs_keys_and_sequence(spark, keys, seq):
    assert "upsert_without_keys_or_sequence" in violations(spark, "destinations", dst(mode="upsert", keys=keys, sequence_by=seq))


def test_empty_key_name(spark):
    assert "empty_key" in violations(spark, "destinations", dst(keys=["k", ""]))
