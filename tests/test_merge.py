import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace import latest_per_key, upsert

DDL = "k INT, v STRING"


def frame(spark, data, ddl=DDL):
    return spark.createDataFrame(data, ddl)


def merged(target, source):
    """Brute force MERGE: every matched target row is updated, unmatched source rows are added."""
    news = {k: v for k, v in source if k is not None}
    out = [(k, news[k]) if k in news else (k, v) for k, v in target]
    seen = {k for k, _ in target}
    out += [(k, v) for k, v in source if k is None or k not in seen]
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [False, True])
def test_update_and_insert(spark, rows, broadcast):
    target, source = [(1, "a"), (2, "b"), (None, "n")], [(2, "B"), (3, "C"), (None, "N")]
    out = upsert(frame(spark, target), frame(spark, source), "k", broadcast_source=broadcast)
    assert rows(out) == merged(target, source)


def test_empty_sides(spark, rows):
    some = [(1, "a"), (None, "b")]
    assert rows(upsert(frame(spark, []), frame(spark, some), "k")) == sorted(some, key=repr)
    assert rows(upsert(frame(spark, some), frame(spark, []), "k")) == sorted(some, key=repr)


def test_idempotent(spark, rows):
    target, source = frame(spark, [(1, "a"), (2, "b")]), frame(spark, [(2, "B"), (3, "C")])
    once = upsert(target, source, ["k"])
    assert rows(upsert(once, source, ["k"])) == rows(once)


def test_null_safe(spark, rows):
    out = upsert(frame(spark, [(None, "old"), (1, "a")]), frame(spark, [(None, "new")]), "k", null_safe=True)
    assert rows(out) == [(1, "a"), (None, "new")]


def test_repeated_source_key(spark, rows):
    target, source = frame(spark, [(1, "a")]), frame(spark, [(1, "x"), (1, "y"), (2, "z")])
    with pytest.raises(Exception, match="repeated key in upsert source: k=1"):
        upsert(target, source, "k").collect()
    assert rows(upsert(target, source, "k", order_by="v")) == [(1, "y"), (2, "z")]
    assert rows(upsert(target, source, "k", order_by=F.col("v").asc())) == [(1, "x"), (2, "z")]
    ordered = source.withColumn("at", F.when(F.col("v") == "x", 9).otherwise(1))
    assert rows(upsert(target, ordered, "k", order_by="at")) == [(1, "x"), (2, "z")]


def test_repeated_target_key(spark, rows):
    target, source = [(1, "a"), (1, "b"), (2, "c"), (None, "n")], [(1, "X"), (3, "Z"), (None, "N")]
    out = upsert(frame(spark, target), frame(spark, source), "k", repeated_target_keys=True)
    assert rows(out) == merged(target, source)


def test_composite_key_with_a_null_part(spark, rows):
    ddl = "a INT, b STRING, v INT"
    out = upsert(frame(spark, [(1, "x", 1), (1, None, 2)], ddl), frame(spark, [(1, "x", 9), (1, None, 8)], ddl),
                 ["a", "b"])
    assert rows(out) == [(1, "x", 9), (1, None, 2), (1, None, 8)]


def test_columns(spark, rows):
    target = frame(spark, [(1, 5)], "k LONG, v INT")
    out = upsert(target, frame(spark, [("q", 7, 2)], "extra STRING, v INT, k INT"), "k")
    assert out.schema.simpleString() == target.schema.simpleString()
    assert rows(out) == [(1, 5), (2, 7)]
    with pytest.raises(ValueError, match="source has no column v"):
        upsert(target, frame(spark, [(1,)], "k INT"), "k")
    with pytest.raises(ValueError, match="at least one key"):
        upsert(target, target, [])
    with pytest.raises(ValueError, match="holds a map"):
        m = spark.sql("SELECT map(1, 2) AS k")
        upsert(m, m, "k")


def test_map_as_payload(spark):
    target = spark.sql("SELECT 1 AS k, map('a', 1) AS m")
    source = spark.sql("SELECT 1 AS k, map('b', 2) AS m")
    assert upsert(target, source, "k").collect()[0]["m"] == {"b": 2}


pairs = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.sampled_from("abc")), max_size=8)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(target=pairs, source=pairs)
def test_any_merge(spark, rows, target, source):
    """Against brute force; repeats are removed from the source, allowed in the target."""
    source = list({k: (k, v) for k, v in source if k is not None}.values()) + [s for s in source if s[0] is None]
    t, s = frame(spark, target), frame(spark, source)
    assert rows(upsert(t, s, "k", repeated_target_keys=True)) == merged(target, source)
    if len({k for k, _ in target if k is not None}) == len([k for k, _ in target if k is not None]):
        assert rows(upsert(t, s, "k")) == merged(target, source)


def test_plan(spark, folder):
    """Null keys do not travel, the target is read as stored, and nothing runs in Python."""
    a, b = folder(), folder()
    frame(spark, [(1, "a")]).write.parquet(a)
    frame(spark, [(1, "b")]).write.parquet(b)
    out = upsert(spark.read.parquet(a), spark.read.parquet(b), "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "Python" not in plan and "CartesianProduct" not in plan
    assert "IsNotNull(k)" in plan and "IsNull(k)" in plan


def test_latest_per_key(spark, rows):
    df = frame(spark, [(1, "a"), (1, "c"), (1, None), (2, None), (None, "x"), (None, "y")])
    assert rows(latest_per_key(df, "k", "v")) == [(1, "c"), (2, None), (None, "y")]
