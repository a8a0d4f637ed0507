"""Python-exact string helpers, checked against Python itself."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions.text import digit_parse, is_blank, py_strip, resolve_against

WS = [chr(c) for c in range(0x110000) if chr(c).isspace()]
alphabet = st.sampled_from(WS + list("ab.7​᠎"))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(alphabet=alphabet, max_size=8), min_size=1, max_size=40))
def test_strip_and_blank_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = df.select("s", py_strip("s").alias("t"), is_blank("s").alias("b")).collect()
    for r in got:
        assert r.t == r.s.strip(), repr(r.s)
        assert r.b == (not r.s.strip()), repr(r.s)


def test_digit_parse_and_paths(spark):
    df = spark.createDataFrame([("12",), ("x1",), ("",), (" 3",), ("0007",)], "s string")
    assert [r[0] for r in df.select(digit_parse("s")).collect()] == [12, None, None, None, 7]
    paths = spark.createDataFrame([("a/b.csv", "/cfg"), ("/abs/./x.sql", "/cfg"), (None, "/cfg"), ("", "/cfg")],
                                  "p string, d string")
    got = [r[0] for r in paths.select(resolve_against(F.col("p"), F.col("d"))).collect()]
    assert got == ["/cfg/a/b.csv", "/abs/x.sql", None, None]
