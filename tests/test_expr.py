import pytest

from sluice.functions.expr import UnsafeExpression, transform_to_column


def test_python_spelling_runs(spark):
    df = spark.createDataFrame([("  Ab,c ",)], "label string")
    col = transform_to_column("F.upper(F.trim(F.col('label')))")
    assert df.select(col).first()[0] == "AB,C"


def test_sql_spelling_runs(spark):
    df = spark.createDataFrame([(2,)], "x int")
    assert df.select(transform_to_column("x * 10 + 1")).first()[0] == 21


def test_operators_and_methods(spark):
    df = spark.createDataFrame([(2, "ab")], "x int, s string")
    col = transform_to_column("(F.col('x') + 1) * 2 == 6")
    assert df.select(col).first()[0] is True
    assert df.select(transform_to_column("F.col('s').substr(1, 1)")).first()[0] == "a"


@pytest.mark.parametrize("text", [
    "F.udf(lambda x: x)",
    "F.col('x').__class__",
    "F.col('x')._jc",
    "F.expr('1') if True else None",
    "F.lit([].__class__)",
    "F.col('x').alias(__import__('os').system('true'))",
])
def test_unsafe_python_text_is_rejected(text):
    with pytest.raises(UnsafeExpression):
        transform_to_column(text)


@pytest.mark.parametrize("text", ["__import__('os').system('true')", "open('/etc/passwd')"])
def test_other_text_is_only_ever_spark_sql(spark, text):
    """Without an ``F.`` call the text goes to the SQL parser, never to Python."""
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(Exception) as info:
        df.select(transform_to_column(text)).collect()
    assert not isinstance(info.value, UnsafeExpression)


def test_guarded_casts_equal_try_cast(spark):
    """The cheap pre-check before string casts never changes a result."""
    import random

    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from sluice.functions.types import cast_to
    rnd = random.Random(11)
    alpha = "0123456789+-.eEdDfFxXpPaAnNiItTyYsS \t\x0b_１"
    vals = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 6))) for _ in range(3000)]
    vals += ["NaN", "-Infinity", "inf", "0x1p3", "1e3", "1d", ".5", "1.", "TRUE", " no ", "2147483648", "+0"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    for name in ("int", "double", "boolean"):
        a, b = cast_to(F.col("s"), name, T.StringType()), F.col("s").try_cast(name)
        same = a.eqNullSafe(b) | (F.isnan(a) & F.isnan(b) if name == "double" else F.lit(False))
        assert df.filter(~same).count() == 0, name


@pytest.mark.parametrize("text, value", [
    ("F.transform(F.col('a'), lambda x: x + 1)", [2, 3, None]),
    ("F.filter(F.col('a'), lambda x: x.isNotNull() & (x > 1))", [2]),
    ("F.aggregate(F.col('a'), F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)), lambda r: r * 10)", 30),
    ("F.transform(F.col('a'), lambda x: F.filter(F.col('a'), lambda y: y > x))", [[2], [], []]),
    ("F.transform(col='a', f=lambda x, i: i)", [0, 1, 2]),
    ("F.map_filter(F.col('m'), lambda k, v: v > 2)", {"z": 5}),
])
def test_lambdas_become_spark_lambda_variables(spark, text, value):
    df = spark.sql("SELECT array(1, 2, NULL) AS a, map('k', 1, 'z', 5) AS m")
    assert df.select(transform_to_column(text)).first()[0] == value


@pytest.mark.parametrize("text", [
    "F.upper(lambda x: x)", "F.transform(F.col('a'), lambda *x: x)", "F.transform(F.col('a'), lambda x: __import__('os'))",
    "F.transform(F.col('a'), lambda F: F)", "F.transform(F.col('a'), lambda x: x.__class__)", "F.transform(F.col('a'), lambda x: y)",
    "(lambda x: x)(F.col('a'))", "F.transform(F.col('a'), lambda x=1: x)",
])
def test_other_lambdas_are_refused(spark, text):
    df = spark.sql("SELECT array(1) AS a")
    with pytest.raises(UnsafeExpression):
        df.select(transform_to_column(text))
