from pyspark.sql import functions as F

from sluice.functions.json import decode_params, encode_params
from sluice.functions.sanitize import drop_all_null_columns, sanitize_frame
from sluice.model import stage_frame
from sluice.sinks.tables import create_database, overwrite_table
from sluice.sources.declared import decode_params as options_of, read_metadata_table


def test_drop_all_null_columns_after_cleaning(spark):
    df = spark.createDataFrame([("a", " ", None), ("b", "", None)], "x string, blank string, gone int")
    out = drop_all_null_columns(sanitize_frame(df))
    assert out.columns == ["x"]


def test_params_round_trip(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": true}}',), (None,)], "p string")
    m = df.select(decode_params("p").alias("m"))
    got = [r.m for r in m.collect()]
    assert got[0] == {"a": "1", "b": '{"c":true}'} and got[1] is None
    enc = m.select(encode_params("m", m.schema["m"].dataType).alias("j")).first().j
    assert enc == '{"a":"1","b":"{\\"c\\":true}"}'
    assert df.select(encode_params("p", df.schema["p"].dataType)).first()[0] == '{"a": 1, "b": {"c": true}}'


def test_source_options_from_params():
    assert options_of('{"header": true, "sep": ";", "n": 3, "nested": {"x": 1}}') == {
        "header": "true", "sep": ";", "n": "3", "nested": '{"x": 1}'}
    assert options_of(None) == {} and options_of("") == {}


def test_metadata_table_scan(spark, scratch):
    create_database(spark, "sluice_scan")
    rows = [("c", "s", "p", "o", "parquet", "t", None, None)]
    overwrite_table(stage_frame(spark, "sources", rows), "sluice_scan.sources", path=f"{scratch}/src")
    assert [tuple(r)[:3] for r in read_metadata_table(spark, "sources", "sluice_scan").collect()] == [("c", "s", "p")]
    assert read_metadata_table(spark, "sources", "sluice_scan").filter(F.col("target") == "t").count() == 1


def test_uri_paths_are_absolute(spark):
    from sluice.functions.text import resolve_against
    df = spark.createDataFrame([("s3a://bkt/tbl",), ("file:/x/y",), ("a/b",)], "p string")
    assert [r[0] for r in df.select(resolve_against("p", F.lit("/conf"))).collect()] == ["s3a://bkt/tbl", "/x/y", "/conf/a/b"]


def test_bad_utf8_and_long_parser_messages_are_reported_whole():
    from sluice.sources.configs import _decoded
    assert _decoded(b'{"a": "\xff"}', ".json")[1].startswith("not valid UTF-8")
    assert len(_decoded(b"a: [" + b"x" * 500 + b"\n: :", ".yaml")[1]) > 230
