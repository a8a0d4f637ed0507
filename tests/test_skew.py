"""One key holding a third of all rows: results stay whole and exact, plans stay partial."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.operators import reconcile as R
from sluice.operators.quality import conflicting_rules
from sluice.operators.upsert import upsert

N = 30000


@pytest.fixture(scope="module")
def skewed(spark):
    # key 0 owns every third row; the rest spread over 2000 keys
    df = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 2000 + 1).alias("k"),
        F.col("id").alias("seq"),
        (F.col("id") * 7 % 101).cast("string").alias("v"))
    return df, [tuple(r) for r in df.collect()]


def test_session_has_skew_handling_on(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_upsert_on_a_hot_key(spark, skewed):
    df, rows = skewed
    best = {}
    for k, s, v in rows:
        if k not in best or s > best[k][1]:
            best[k] = (k, s, v)
    got = sorted(tuple(r) for r in upsert(None, df, ["k"], "seq").collect())
    assert got == sorted(best.values())
    assert sum(1 for k, _, _ in rows if k == 0) == N // 3


def test_lookup_on_a_hot_key(spark, skewed):
    df, rows = skewed
    left = spark.range(0, 2002).select(F.col("id").alias("k"))
    first = {r.k: r.v for r in R.lookup(left, df, "k", "v", "seq").collect()}
    expect = {}
    for k, s, v in sorted(rows, key=lambda r: r[1]):
        expect.setdefault(k, v)
    assert first == {k: expect.get(k) for k in range(2002)}


def test_rule_groups_on_a_hot_value(spark, skewed):
    df, rows = skewed
    rules = df.select(F.concat(F.lit(" rule "), F.col("k")).alias("rule"), F.col("v").alias("action"),
                      F.col("seq").alias("pos"))
    got = conflicting_rules(rules, "rule", "action", "pos")
    counts = defaultdict(int)
    for k, _, _ in rows:
        counts[f"rule {k}"] += 1
    members = sum(n for n in counts.values() if n > 1)
    assert got.count() == members
    hot = got.filter(F.col("rule_key") == "rule 0").select("n_actions").distinct().collect()
    assert [r[0] for r in hot] == [N // 3]


def test_anti_join_with_a_hot_key(spark, skewed):
    df, rows = skewed
    declared = spark.range(1, 1500).select(F.col("id").alias("name"))
    deployed = df.select(F.col("k").alias("name"), F.col("v").alias("pipeline_id"))
    got = R.obsolete(deployed, declared).count()
    assert got == sum(1 for k, _, _ in rows if not (1 <= k < 1500))
