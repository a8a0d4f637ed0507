"""Nested empty-value cleaning checked against a small Python model of the rules."""

import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.sanitize import is_empty, sanitize_frame

# -- a Python model of the semantics, over values that fit the schema below


def _protects(v):
    return isinstance(v, (bool, int)) and not isinstance(v, float)


def _falsy(v, kind):
    if v is None:
        return True
    if kind == "struct":
        return all(x is None for x in v.values())
    if isinstance(v, (bool, int)):
        return False
    if isinstance(v, float):
        return v == 0.0
    return len(v) == 0


def model_empty(v, kind, child_kinds=None):
    if v is None:
        return False
    if kind == "string":
        return not v.strip()
    if kind in ("array", "map"):
        vals = v if kind == "array" else list(v.values())
        return all(_falsy(x, child_kinds) and not _protects(x) for x in vals)
    if kind == "struct":
        return all(_falsy(v[n], k) for n, k in child_kinds.items())
    return False


def model_clean(v, kind, child, drop):
    """kind/child describe the value; returns the cleaned value."""
    if v is None:
        return None
    if model_empty(v, kind, child if kind != "array" and kind != "map" else child[0]):
        return None
    if kind == "string":
        return v
    if kind == "array":
        out = [model_clean(x, child[0], child[1], drop) for x in v]
        return [x for x in out if x is not None] if drop else out
    if kind == "map":
        out = {k.replace(".", "_"): model_clean(x, child[0], child[1], drop) for k, x in v.items()}
        return {k: x for k, x in out.items() if x is not None} if drop else out
    if kind == "struct":
        return {n: model_clean(v[n], k, None, drop) if k == "string" else v[n] for n, k in child.items()}
    return v


SCHEMA = T.StructType([
    T.StructField("s", T.StringType()),
    T.StructField("arr", T.ArrayType(T.StringType())),
    T.StructField("nums", T.ArrayType(T.DoubleType())),
    T.StructField("ints", T.ArrayType(T.LongType())),
    T.StructField("m", T.MapType(T.StringType(), T.StringType())),
    T.StructField("st", T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.DoubleType())])),
])
KINDS = {"s": ("string", None), "arr": ("array", ("string", None)), "nums": ("array", ("double", None)),
         "ints": ("array", ("long", None)), "m": ("map", ("string", None)),
         "st": ("struct", {"a": "string", "b": "double"})}

blankish = st.sampled_from(["", " ", "\t", "　", "\x1c", "x", " y ", "a.b"])
text = st.one_of(st.none(), blankish, st.text(alphabet=string.ascii_letters + " ", max_size=4))
row = st.fixed_dictionaries({
    "s": text,
    "arr": st.one_of(st.none(), st.lists(text, max_size=4)),
    "nums": st.one_of(st.none(), st.lists(st.one_of(st.none(), st.sampled_from([0.0, 1.5, -2.0])), max_size=3)),
    "ints": st.one_of(st.none(), st.lists(st.one_of(st.none(), st.sampled_from([0, 3])), max_size=3)),
    "m": st.one_of(st.none(), st.dictionaries(st.sampled_from(["k", "k.1", "z"]), text, max_size=3)),
    "st": st.one_of(st.none(), st.fixed_dictionaries({"a": text, "b": st.one_of(st.none(), st.just(0.0), st.just(2.0))})),
})


def _as_py(v):
    if hasattr(v, "asDict"):
        return {k: _as_py(x) for k, x in v.asDict().items()}
    if isinstance(v, list):
        return [_as_py(x) for x in v]
    if isinstance(v, dict):
        return {k: _as_py(x) for k, x in v.items()}
    return v


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, min_size=1, max_size=6), drop=st.booleans())
def test_sanitize_matches_model(spark, rows, drop):
    df = spark.createDataFrame([tuple(r[f.name] for f in SCHEMA.fields) for r in rows], SCHEMA)
    got = [_as_py(r.asDict()) for r in sanitize_frame(df, drop_empty=drop).collect()]
    for g, r in zip(got, rows):
        for name, (kind, child) in KINDS.items():
            expect = model_clean(r[name], kind, child, drop)
            assert g[name] == expect, (name, r[name], g[name], expect)


def test_is_empty_truthiness_corners(spark):
    df = spark.createDataFrame([([0.0],), ([],), ([None],), ([1.0],)], "x array<double>")
    got = [r[0] for r in df.select(is_empty(F.col("x"), df.schema["x"].dataType)).collect()]
    assert got == [True, True, True, False]
    ints = spark.createDataFrame([([0],), ([None],)], "x array<long>")
    assert [r[0] for r in ints.select(is_empty(F.col("x"), ints.schema["x"].dataType)).collect()] == [False, True]


def test_checked_once_top_down(spark):
    """{"a": {"b": {"c": ""}}} with dropping keeps an empty inner map."""
    df = spark.createDataFrame([({"b": {"c": ""}},)], "a map<string,map<string,string>>")
    out = sanitize_frame(df, drop_empty=True).first()
    assert out.a == {}  # "b" is judged (empty) and dropped; "a" was judged before, so it stays


def test_map_key_rename_last_wins(spark):
    df = spark.sql("SELECT map('a.b', '1', 'a_b', '2', 'c', '3') AS m, 1 AS `x.y`")
    out = sanitize_frame(df)
    assert out.columns == ["m", "x_y"]
    assert out.first().m == {"a_b": "2", "c": "3"}


def test_struct_field_collision_is_an_error(spark):
    df = spark.sql("SELECT named_struct('a.b', 1, 'a_b', 2) AS s")
    import pytest
    with pytest.raises(ValueError):
        sanitize_frame(df)


def test_maps_without_dots_take_the_fast_path_with_same_result(spark):
    df = spark.sql("SELECT map('a', '', 'b', 'x') AS m UNION ALL SELECT map('a.b', '', 'c', ' ')")
    # ' ' is a truthy child, so the second map survives its own check; its entries are
    # then cleaned one level down (both become NULL: dropped, or kept as NULL)
    assert [r.m for r in sanitize_frame(df, drop_empty=True).collect()] == [{"b": "x"}, {}]
    assert [r.m for r in sanitize_frame(df).collect()] == [{"a": None, "b": "x"}, {"a_b": None, "c": None}]
