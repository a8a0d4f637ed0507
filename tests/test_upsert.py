from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sluice.operators.upsert import upsert
from sluice.sinks.upsert_store import UpsertStore

SCHEMA = "k int, seq int, v string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_latest_sequence_wins_and_batch_beats_stored_on_ties(spark):
    target = spark.createDataFrame([(1, 5, "old"), (2, 5, "stored"), (3, 1, "keep")], SCHEMA)
    batch = spark.createDataFrame([(1, 7, "new"), (1, 6, "mid"), (2, 5, "incoming"), (4, None, "nulls")], SCHEMA)
    out = rows(upsert(target, batch, ["k"], "seq"))
    assert out == [(1, 7, "new"), (2, 5, "incoming"), (3, 1, "keep"), (4, None, "nulls")]


def test_null_sequence_loses_and_null_keys_group(spark):
    batch = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (5, None, "x"), (5, 0, "y")], SCHEMA)
    assert rows(upsert(None, batch, ["k"], "seq")) == [(5, 0, "y"), (None, 2, "b")]


def test_ties_inside_a_batch_are_deterministic(spark):
    batch = spark.createDataFrame([(1, 3, "a"), (1, 3, "c"), (1, 3, "b")], SCHEMA)
    assert rows(upsert(None, batch, ["k"], "seq")) == [(1, 3, "c")]


def test_plan_limits_rows_per_key_before_the_shuffle(spark):
    batch = spark.createDataFrame([(1, 3, "a")], SCHEMA)
    plan = upsert(None, batch, ["k"], "seq")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


triples = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 30), st.sampled_from("abc")), max_size=12)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=triples, b=triples)
def test_idempotent_and_order_independent(spark, a, b):
    # distinct sequence values per key make the order of arrival irrelevant
    seen, a2, b2 = set(), [], []
    for src, dst in ((a, a2), (b, b2)):
        for k, s, v in src:
            if (k, s) not in seen:
                seen.add((k, s))
                dst.append((k, s, v))
    A = spark.createDataFrame(a2, SCHEMA)
    B = spark.createDataFrame(b2, SCHEMA)
    ab = upsert(upsert(None, A, ["k"], "seq"), B, ["k"], "seq")
    ba = upsert(upsert(None, B, ["k"], "seq"), A, ["k"], "seq")
    assert rows(ab) == rows(ba)
    assert rows(upsert(ab, B, ["k"], "seq")) == rows(ab)


def test_a_replayed_batch_replaces_itself_and_streams_do_not_meet(spark, scratch):
    store = UpsertStore(spark, f"{scratch}/t", ["k"], "seq")
    assert store.read() is None
    store.merge(spark.createDataFrame([(i, 1, "v1") for i in range(40)], SCHEMA), "a", 5)
    store.merge(spark.createDataFrame([(3, 2, "b0")], SCHEMA), "b", 0)      # lower id, other stream: kept
    store.merge(spark.createDataFrame([(4, 2, "x")], SCHEMA), "b", 1)
    store.merge(spark.createDataFrame([(4, 2, "y")], SCHEMA), "b", 1)       # replay
    got = {r.k: (r.seq, r.v) for r in store.read().collect()}
    assert len(got) == 40 and got[3] == (2, "b0") and got[4] == (2, "y") and got[5] == (1, "v1")


def test_an_equal_sequence_goes_to_the_later_batch_also_after_compaction(spark, scratch):
    store = UpsertStore(spark, f"{scratch}/t", ["k"], "seq")
    store.merge(spark.createDataFrame([(1, 1, "z"), (2, 1, "z")], SCHEMA))
    store.merge(spark.createDataFrame([(1, 1, "a")], SCHEMA))
    expect = [(1, 1, "a"), (2, 1, "z")]
    assert rows(store.read()) == expect
    assert store.compact() == 2 and store.compact() == 0
    assert rows(store.read()) == expect
    store.merge(spark.createDataFrame([(2, 1, "b")], SCHEMA))
    assert rows(store.read()) == [(1, 1, "a"), (2, 1, "b")]


def test_a_compaction_lost_before_its_deletions_changes_nothing(spark, scratch, monkeypatch):
    import pytest

    from sluice.sinks import batches
    store = UpsertStore(spark, f"{scratch}/t", ["k"], "seq")
    for v in "ab":
        store.merge(spark.createDataFrame([(1, 1, v), (2, 1, v)], SCHEMA))

    def lost(*_):
        raise RuntimeError("driver lost")
    monkeypatch.setattr(batches, "delete_path", lost)
    with pytest.raises(RuntimeError):
        store.compact()
    monkeypatch.undo()
    assert rows(store.read()) == [(1, 1, "b"), (2, 1, "b")]


def test_new_columns_are_kept_and_other_types_refused(spark, scratch):
    import pytest

    from sluice.sinks.batches import SchemaMismatch
    store = UpsertStore(spark, f"{scratch}/t", ["k"], "seq")
    store.merge(spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], SCHEMA))
    store.merge(spark.createDataFrame([(1, 2, "b", 7)], SCHEMA + ", extra int"))
    store.merge(spark.createDataFrame([(3, 1, "c")], SCHEMA))
    expect = [(1, 2, "b", 7), (2, 1, "a", None), (3, 1, "c", None)]
    assert rows(store.read()) == sorted(expect, key=repr)
    with pytest.raises(SchemaMismatch):
        store.merge(spark.createDataFrame([(1, 3, "d")], "k long, seq int, v string"))
    assert rows(store.read()) == sorted(expect, key=repr)


def test_full_refresh_replaces_rows_and_types(spark, scratch):
    store = UpsertStore(spark, f"{scratch}/t", ["k"], "seq")
    store.merge(spark.createDataFrame([(1, 1, "a")], SCHEMA))
    store.merge(spark.createDataFrame([(9, 1, "n")], "k long, seq int, v string"), replace_all=True)
    assert rows(store.read()) == [(9, 1, "n")]
    store.truncate()
    assert store.read() is None
