from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions.aggregates import Aggregate, aggregate, call_table_function, register_table_function, Runs, weighted_quantile
from millrace.functions import aggregates
from millrace.functions.transforms import python_step, sql_block
from millrace.plans.run import build_increment
from millrace.plans.spec import flow

TOTAL = Aggregate(lambda b: str(sum(v or 0 for v in b.column(0).to_pylist())).encode(), lambda s: str(sum(map(int, s))).encode(), int, "bigint")


def test_states_are_merged_whatever_their_number(spark, rows, monkeypatch):
    """One key for all rows, NULL as a key, tiny limits: many partial states, two levels of merges."""
    monkeypatch.setattr(aggregates, "STATES_AT_ONCE", 2)
    monkeypatch.setattr(aggregates, "KEYS_HELD", 1)
    df = spark.range(0, 5_000, 1, 16).select(F.when(F.col("id") % 1000 == 0, None).otherwise(F.col("id") % 2).alias("k"), F.lit("x").alias("part"), "id")
    want = sorted([(None, "x", 10_000), (0, "x", sum(n for n in range(0, 5_000, 2) if n % 1000)), (1, "x", sum(range(1, 5_000, 2)))], key=repr)
    assert rows(aggregate(df, TOTAL, ["k", "part"], "id")) == want
    assert rows(aggregate(df.limit(0), TOTAL, "k", "id")) == []


def test_a_hot_key_is_states_before_it_is_shuffled(spark):
    df = spark.range(0, 40_000, 1, 8).select(F.lit(1).alias("k"), "id")
    plan = aggregate(df, TOTAL, "k", "id")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below                      # rows are folded where they are read


def test_weighted_quantile_against_sorting(spark, rows):
    data = [("a", v, w) for v, w in ((3.0, 2), (1.0, 1), (9.0, 1), (None, 7), (4.0, 0), (5.0, None))] + [("b", None, 1), ("c", 2.0, 10 ** 12)]
    df = spark.createDataFrame(data, "k STRING, v DOUBLE, w LONG")
    for q, want in ((0.0, 1.0), (0.25, 1.0), (0.5, 3.0), (0.75, 3.0), (0.76, 9.0), (1.0, 9.0)):
        assert rows(aggregate(df, weighted_quantile(q), "k", ["v", "w"], "q")) == [("a", want), ("b", None), ("c", 2.0)]


def test_aggregates_and_table_functions_in_flows(spark, folder, rows):
    feed = folder()
    t = [datetime(2020, 1, 1, h) for h in range(6)]
    data = [("a", "x", t[0]), ("a", "x", t[1]), ("a", None, t[2]), ("a", None, t[3]), ("a", "x", t[4]), (None, "y", t[5])]
    spark.createDataFrame(data, "k STRING, v STRING, at TIMESTAMP_NTZ").write.parquet(feed)
    want = sorted([("a", "x", t[0], t[1], 2), ("a", None, t[2], t[3], 2), ("a", "x", t[4], t[4], 1), (None, "y", t[5], t[5], 1)], key=repr)
    spec = flow("f").source("parquet", path=feed).python("table_function", name="runs", partition_by="k", order_by="at").target("parquet", path=folder()).spec()
    assert rows(build_increment(spark, spec)) == want
    register_table_function(spark, "islands", Runs, "key STRING, value STRING, first_at TIMESTAMP_NTZ, last_at TIMESTAMP_NTZ, length BIGINT")
    df = spark.read.parquet(feed)
    assert rows(sql_block(df, "SELECT * FROM islands(TABLE(temp_table) PARTITION BY k ORDER BY at)")) == want
    aggregates.register_aggregate("total", TOTAL)
    step = python_step("aggregate", {"name": "total", "keys": "v", "columns": "n"})
    assert rows(df.withColumn("n", F.lit(2)).transform(step)) == sorted([("x", 6), (None, 4), ("y", 2)], key=repr)
    for bad in (lambda: aggregate(df, "unknown", "k", "v"), lambda: call_table_function(df, "unknown", "k"), lambda: aggregate(df, TOTAL, "k", "nothing")):
        with pytest.raises(ValueError):
            bad()
