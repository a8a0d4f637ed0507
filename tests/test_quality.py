import pytest
from pyspark.sql import functions as F

from sluice.operators.quality import (Rule, ValidationFailed, apply_rules, audit, conflicting_rules,
                                      drop_violations, enforce_fail, row_rule_conflicts)


def test_rule_enum_is_upper_case_only():
    with pytest.raises(ValueError):
        Rule("x > 0", "drop")
    with pytest.raises(ValueError):
        Rule("  ", "LOG")
    assert Rule("x > 0", "FAIL").action == "FAIL"


def test_null_rule_result_counts_as_violation(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    assert drop_violations(df, [Rule("x > 0", "DROP")]).count() == 1
    row = audit(df, [Rule("x > 0", "LOG")]).first()
    assert (row.checked, row.violations) == (3, 2)


def test_log_keeps_rows_and_counts(spark):
    df = spark.range(10)
    kept, aud = apply_rules(df, [Rule("id < 7", "LOG"), Rule("id % 2 = 0", "DROP")])
    assert kept.count() == 5
    got = {r.rule: r.violations for r in aud.collect()}
    assert got == {"id < 7": 3, "id % 2 = 0": 5}


def test_all_rules_see_the_same_input(spark):
    df = spark.range(10)
    _, aud = apply_rules(df, [Rule("id % 2 = 0", "DROP"), Rule("id < 5", "LOG")])
    assert {r.rule: r.checked for r in aud.collect()} == {"id % 2 = 0": 10, "id < 5": 10}


def test_fail_raises_with_counts(spark):
    df = spark.range(10)
    with pytest.raises(ValidationFailed) as info:
        enforce_fail(df, [Rule("id < 8", "FAIL"), Rule("id >= 0", "FAIL")], stage="s")
    assert info.value.failures == [("id < 8", 2)]


def test_fail_is_not_escaped_by_pruning_filters_or_limits(spark, scratch):
    """Violating rows sit in a separate file that a later filter or limit would skip.

    A lazy ``raise_error`` column is escaped by those shapes; the eager audit is not.
    """
    spark.range(0, 100).write.parquet(f"{scratch}/good")
    spark.range(1000, 1003).write.parquet(f"{scratch}/bad")
    df = spark.read.parquet(f"{scratch}/good", f"{scratch}/bad")
    lazy = df.withColumn("chk", F.when(F.col("id") >= 500, F.raise_error(F.lit("bad"))))
    assert lazy.select("id").count() == 103          # the check column is pruned away
    assert lazy.filter("id < 100").count() == 100     # the bad file is filtered out
    with pytest.raises(ValidationFailed):
        enforce_fail(df, [Rule("id < 500", "FAIL")])


def test_conflicting_rules_group_after_python_strip(spark):
    rows = [("x > 0", "LOG", 1), ("　x > 0 ", "DROP", 2), ("y > 0", "LOG", 3), ("x>0", "LOG", 4)]
    df = spark.createDataFrame(rows, "rule string, action string, pos int")
    out = conflicting_rules(df, "rule", "action", "pos").orderBy("pos").collect()
    assert [(r.rule_key, r.n_actions, r.pos, r.action) for r in out] == [("x > 0", 2, 1, "LOG"),
                                                                          ("x > 0", 2, 2, "DROP")]


def test_same_rule_twice_with_same_action_still_conflicts(spark):
    df = spark.createDataFrame([("a", "LOG", 1), ("a", "LOG", 2)], "rule string, action string, pos int")
    assert conflicting_rules(df, "rule", "action", "pos").count() == 2


def test_row_level_rule_conflicts(spark):
    df = spark.createDataFrame(
        [([("a", "LOG"), (" a", "DROP"), ("b", "LOG")],), ([("a", "LOG")],), ([],)],
        "v array<struct<validation_rule:string,validation_action:string>>")
    got = [r[0] for r in df.select(row_rule_conflicts(F.col("v"))).collect()]
    assert got == [["a"], [], []]
