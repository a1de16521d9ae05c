import math
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace import asof_join, band_join, interval_join
from millrace.operators import timejoins

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
T0 = datetime(2020, 1, 1)
key = st.sampled_from([None, "a", "b"])
moment = st.one_of(st.none(), st.integers(-40, 40))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@QUICK
@given(left=st.lists(st.tuples(key, moment), max_size=12), right=st.lists(st.tuples(key, moment), max_size=12, unique=True), slices=st.sampled_from([1, 3, 500]))
def test_asof_against_brute_force(spark, rows, left, right, slices):
    a = spark.createDataFrame([(n, *r) for n, r in enumerate(left)], "n INT, k STRING, x INT")
    b = spark.createDataFrame([(*r, n) for n, r in enumerate(right)], "k STRING, y INT, m INT")
    want = []
    for n, (k, x) in enumerate(left):
        hits = [(y, m) for m, (q, y) in enumerate(right) if k is not None and q == k and None not in (x, y) and y <= x]
        want.append((n, k, x, *max(hits, default=(None, None))))
    got = asof_join(a, b, "k", "x", "y", slices=slices)
    assert got.columns == ["n", "k", "x", "y", "m"] and rows(got) == sorted(want, key=repr)
    assert rows(asof_join(a, b, "k", "x", "y", how="inner", slices=slices)) == sorted((w for w in want if w[3] is not None), key=repr)


def test_asof_times_ties_and_types(spark, rows):
    left = spark.createDataFrame([(1, T0 + timedelta(hours=h)) for h in (-1, 0, 5, 10_000)], "k INT, t TIMESTAMP_NTZ")
    right = spark.createDataFrame([(1, T0, "x", 1), (1, T0, "y", 2), (1, T0 + timedelta(hours=5, microseconds=1), "z", 3)], "k LONG, at TIMESTAMP_NTZ, v STRING, o INT")
    got = asof_join(left, right, "k", "t", "at", order_by="o", slices=4)
    assert [r[3] for r in rows(got, "t", "k", "at", "v")] == [None, "y", "y", "z"]
    doubles = spark.createDataFrame([(1, math.nan), (1, math.inf), (1, -math.inf), (1, 0.5)], "k INT, t DOUBLE")
    marks = spark.createDataFrame([(1, 0.25, "q"), (1, -math.inf, "low")], "k INT, at DOUBLE, v STRING")
    assert repr(rows(asof_join(doubles, marks, "k", "t", "at"), "t", "v")) == repr(sorted([(math.nan, "q"), (math.inf, "q"), (-math.inf, "low"), (0.5, "q")], key=repr))
    for bad in ({"how": "right"}, {}):
        with pytest.raises(ValueError):
            asof_join(left, right if bad else right.withColumnRenamed("v", "t"), "k", "t", "at", **bad)


def test_a_hot_key_spreads_and_no_range_join_is_planned(spark):
    left = spark.range(4_000).select(F.lit(1).alias("k"), F.col("id").alias("x"))
    right = spark.range(0, 4_000, 7).select(F.lit(1).alias("k"), F.col("id").alias("y"))
    got = asof_join(left, right, "k", "x", "y", slices=50)
    assert got.filter("y <> x - x % 7 OR y IS NULL").count() == 0
    spread = got.groupBy(F.spark_partition_id()).count().count()
    assert spread > 1                                                       # one key, several tasks
    for df in (got, band_join(left, right.drop("k"), "x", "y", 3), interval_join(left, right.withColumn("z", F.col("y") + 3), "k", "x", "y", "z", width=5)):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


@QUICK
@given(points=st.lists(st.tuples(key, moment), max_size=10), spans=st.lists(st.tuples(key, moment, st.sampled_from([None, -1, 0, 1, 7, 60])), max_size=10))
def test_intervals_against_brute_force(spark, rows, points, spans):
    ends = [(k, s, None if None in (s, n) else s + n) for k, s, n in spans]
    a = spark.createDataFrame(points, "k STRING, x INT")
    b = spark.createDataFrame([(*r, n) for n, r in enumerate(ends)], "k STRING, s INT, e INT, n INT")
    want = [(k, x, s, e, n) for k, x in points for n, (q, s, e) in enumerate(ends) if k is not None and k == q and None not in (x, s, e) and s <= x < e]
    assert rows(interval_join(a, b, "k", "x", "s", "e", width=4)) == sorted(want, key=repr)


def test_interval_sides_are_never_broadcast(spark):
    # Looked up on every level, a side is many times what Spark takes it for.
    points = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"))
    spans = points.select("k", F.col("x").alias("s"), (F.col("x") + F.pow(F.lit(2), F.col("x") % 9).cast("long")).alias("e"))
    got = interval_join(points, spans, "k", "x", "s", "e", width=1)
    assert got.count() == points.join(spans, "k").filter("s <= x AND x < e").count()
    assert "Broadcast" not in plan(got) and "SortMergeJoin" in plan(got)


value = st.one_of(st.none(), st.integers(-30, 30).map(lambda n: n / 4), st.just(math.nan))


@QUICK
@given(left=st.lists(value, max_size=14), right=st.lists(value, max_size=14), band=st.sampled_from([0, 0.25, 3]), most=st.sampled_from([2, 1000]))
def test_bands_against_brute_force(spark, rows, left, right, band, most):
    a = spark.createDataFrame([(n, v) for n, v in enumerate(left)], "n INT, x DOUBLE")
    b = spark.createDataFrame([(m, v) for m, v in enumerate(right)], "m INT, y DOUBLE")
    want = [(n, x, m, y) for n, x in enumerate(left) for m, y in enumerate(right) if None not in (x, y) and abs(x - y) <= band]
    assert rows(band_join(a, b, "x", "y", band, bin_rows=most)) == sorted(want, key=repr)


def test_an_overfull_bin_is_a_grid(spark, rows):
    a = spark.range(300).select(F.col("id").alias("n"), F.lit(1.0).alias("x"))
    b = spark.range(200).select(F.col("id").alias("m"), F.lit(1.5).alias("y"))
    got = band_join(a, b, "x", "y", 1, bin_rows=50)
    assert got.count() == 60_000 and got.distinct().count() == 60_000
    with pytest.raises(ValueError):
        band_join(a, b, "x", "y", -1)
    assert timejoins.BIN_ROWS > 1


def test_tasks_of_a_band_are_as_many_as_its_pairs_ask_for(spark, monkeypatch):
    monkeypatch.setattr(timejoins, "TASK_PAIRS", 50_000, raising=False)
    a = spark.range(6_000).select(F.col("id").alias("n"), (F.col("id") % 40).cast("double").alias("x")).coalesce(1)
    b = a.toDF("m", "y")
    got = band_join(a, b, "x", "y", 0.5)
    counts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 40 * 150 * 150 and len(counts) > 10 and max(counts) < sum(counts) / 3   # a few hundred KB, yet many tasks
    assert band_join(a.limit(0), b, "x", "y", 0.5).count() == 0
