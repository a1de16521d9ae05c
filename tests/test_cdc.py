from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from millrace import (CdcConfig, CursorStore, apply_cdc, apply_change_log, high_water_mark,
                      since_sequence, since_timestamp)
from millrace.operators.cdc import bounded_increment, time_literal, upper_bounds

DAY = [datetime(2024, 1, d) for d in range(1, 6)]


@pytest.fixture
def dated(spark):
    return spark.createDataFrame([(i, d) for i, d in enumerate(DAY)] + [(9, None)],
                                 "id INT, updated_at TIMESTAMP_NTZ")


def test_row_on_the_cursor(dated, rows):
    assert rows(since_timestamp(dated, last=DAY[2]), "id") == [(2,), (3,), (4,)]
    assert rows(since_timestamp(dated, last=DAY[2], inclusive=False), "id") == [(3,), (4,)]
    assert rows(since_timestamp(dated, last=DAY[2], until=DAY[3]), "id") == [(2,), (3,)]


def test_nulls_and_lookback(dated, rows):
    assert rows(since_timestamp(dated), "id") == [(0,), (1,), (2,), (3,), (4,)]
    assert rows(since_timestamp(dated, last=DAY[3], nulls="keep"), "id") == [(3,), (4,), (9,)]
    assert rows(since_timestamp(dated, last=DAY[3], lookback="25 hours"), "id") == [(2,), (3,), (4,)]
    with pytest.raises(ValueError, match="nulls"):
        since_timestamp(dated, nulls="maybe")


@pytest.mark.parametrize("ddl, value", [("TIMESTAMP", "2024-01-03 00:00:00"), ("DATE", date(2024, 1, 3)),
                                        ("STRING", "2024-01-03 00:00:00"), ("TIMESTAMP_NTZ", DAY[2])])
def test_cursor_takes_the_type_of_the_column(dated, rows, ddl, value):
    typed = dated.withColumn("updated_at", F.col("updated_at").cast(ddl))
    if ddl == "STRING":
        typed = typed.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))
    out = since_timestamp(typed, last=value)
    assert rows(out, "id") == [(2,), (3,), (4,)]
    assert out.schema == typed.schema


def test_time_zone_of_a_cursor(spark):
    zoned = datetime(2024, 1, 3, 2, tzinfo=timezone(timedelta(hours=2)))
    for ddl in ("TIMESTAMP", "TIMESTAMP_NTZ"):
        dtype = spark.sql(f"SELECT CAST(NULL AS {ddl}) AS x").schema["x"].dataType
        got = spark.range(1).select(time_literal(zoned, dtype).cast("string")).first()[0]
        assert got == "2024-01-03 00:00:00"


def test_sequence(spark, rows):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "sequence_number LONG")
    assert rows(since_sequence(df)) == [(0,), (1,), (2,)]
    assert rows(since_sequence(df, last=0)) == [(1,), (2,)]
    assert rows(since_sequence(df, last=0, until=1)) == [(1,)]
    assert rows(since_sequence(df, last=1, nulls="keep")) == [(2,), (None,)]


def test_switch_and_defaults(dated, rows):
    assert apply_cdc(dated, CdcConfig()) is dated
    assert apply_cdc(dated, CdcConfig.from_mapping({"mode": "nonsense"})) is dated
    assert rows(apply_cdc(dated, CdcConfig.from_mapping({"enabled": True})), "id") == [(i,) for i in range(5)]
    assert apply_cdc(dated, CdcConfig.from_mapping({"enabled": True, "mode": "binlog"})) is dated
    with pytest.raises(ValueError, match="nonsense"):
        CdcConfig.from_mapping({"enabled": True, "mode": "nonsense"})


def test_unusable_cursor_columns(spark, dated):
    with pytest.raises(ValueError, match="not usable as a timestamp cursor"):
        since_timestamp(dated, "id")
    with pytest.raises(ValueError, match="not usable as a sequence cursor"):
        since_sequence(dated, "updated_at")
    with pytest.raises(ValueError, match="no column nowhere"):
        since_timestamp(dated, "nowhere")
    with pytest.raises(ValueError, match="lookback"):
        since_timestamp(dated.withColumn("updated_at", F.col("updated_at").cast("date")), lookback="1 hour")


def test_filter_reaches_the_scan(spark, dated, folder):
    path = folder()
    dated.write.parquet(path)
    for out in (since_timestamp(spark.read.parquet(path), last=DAY[2]),
                since_timestamp(spark.read.parquet(path), last=DAY[2], lookback="1 hour")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(updated_at), GreaterThanOrEqual(updated_at" in plan


def test_high_water_mark(dated, rows):
    assert high_water_mark(dated, "updated_at").first()[0] == DAY[4]
    config = CdcConfig.from_mapping({"enabled": True})
    first, second = upper_bounds([(dated, config, DAY[1]), (dated.limit(0), config, None)])
    assert first.startswith("2024-01-05") and second is None and upper_bounds([]) == []


def test_window_is_closed(dated, rows):
    """What arrives after the bound was taken waits for the next load."""
    config = CdcConfig.from_mapping({"enabled": True})
    assert rows(bounded_increment(dated, config, DAY[1], DAY[2]), "id") == [(1,), (2,)]
    assert rows(bounded_increment(dated, config, DAY[1], None), "id") == []
    keep = CdcConfig.from_mapping({"enabled": True, "nulls": "keep"})
    assert rows(bounded_increment(dated, keep, DAY[1], None), "id") == [(9,)]


def test_cursor_survives_another_time_zone(spark, dated, rows):
    config = CdcConfig.from_mapping({"enabled": True, "inclusive": False})
    zoned = dated.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    upper = upper_bounds([(zoned.filter("id < 3"), config, None)])[0]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        later = since_timestamp(zoned.filter("id < 3"), last=upper, inclusive=False)
        moved = dated.sparkSession.sql(f"SELECT TIMESTAMP '{upper}' AS t").first()["t"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert upper == "2024-01-03 00:00:00.000000Z" and moved is not None
    assert rows(later) == []


def test_cursor_store(spark, folder):
    store = CursorStore(spark, folder("state"))
    assert store.get("flow/a", "ts") is None
    store.put([("flow/a", "ts", "timestamp", DAY[0]), ("flow/b", "n", "sequence", 7)], "run1")
    store.put([("flow/a", "ts", "timestamp", DAY[1])], "run2")
    store.put([("flow/a", "ts", "timestamp", None)], "run3")      # empty increment
    assert store.get("flow/a", "ts").startswith("2024-01-02")
    assert store.get("flow/b", "n") == "7"
    assert store.get("flow/b", "ts") is None


# -- change log --------------------------------------------------------------------------------

def replay(target, log):
    """Brute force: one entry after the other."""
    table = {k: v for k, v in target if k is not None}
    loose = [(k, v) for k, v in target if k is None]
    for op, _, key, value in sorted(log, key=lambda e: e[1]):
        if key is None:
            if op != "D":
                loose.append((key, value))
        elif op == "D":
            table.pop(key, None)
        else:
            table[key] = value
    return sorted([*table.items(), *loose], key=repr)


@pytest.mark.parametrize("log", [
    [],
    [("I", 1, 5, "e"), ("U", 2, 5, "f"), ("D", 3, 5, None)],          # born and gone in one batch
    [("D", 1, 99, None)],                                             # delete of an unknown key
    [("D", 1, 1, None), ("I", 2, 1, "again")],                        # re-insert after delete
    [("I", 9, 2, "late"), ("U", 3, 2, "early"), ("D", 4, 3, None)],   # out of order in the log
    [("I", 1, None, "x"), ("D", 2, None, "y"), ("U", 3, 1, "z")],     # no key
])
@pytest.mark.parametrize("broadcast", [False, True])
def test_change_log_equals_replay(spark, rows, log, broadcast):
    target = [(1, "a"), (2, "b"), (3, "c"), (None, "n")]
    out = apply_change_log(spark.createDataFrame(target, "k INT, v STRING"),
                           spark.createDataFrame(log, "op STRING, seq LONG, k INT, v STRING"), "k",
                           broadcast_log=broadcast)
    assert rows(out) == replay(target, log)


def test_change_log_with_a_hot_key(spark, rows):
    """One key holds most of the log; it is thinned out before the shuffle."""
    log = spark.range(0, 20000).select(
        F.lit("U").alias("op"), F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), F.col("id").alias("v"))
    out = apply_change_log(spark.createDataFrame([(-1, 0)], "k LONG, v LONG"), log, "k")
    assert out.count() == 6667 + 1
    assert rows(out.filter("k = -1")) == [(-1, 19999)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "row_number(), 1, Partial" in plan


def test_change_log_errors(spark):
    target = spark.createDataFrame([(1, "a")], "k INT, v STRING")
    bad = spark.createDataFrame([("X", 1, 1, "b")], "op STRING, seq LONG, k INT, v STRING")
    with pytest.raises(Exception, match="unknown change log operation: X"):
        apply_change_log(target, bad, "k").collect()
    with pytest.raises(ValueError, match="change log has no column v"):
        apply_change_log(target, bad.drop("v"), "k")


def test_nothing_stored_means_everything(spark, rows):
    df = spark.createDataFrame([(1, datetime(1931, 5, 5), -7), (2, datetime(2031, 5, 5), 0), (3, None, None)],
                               "id INT, updated_at TIMESTAMP_NTZ, sequence_number INT")
    assert rows(apply_cdc(df, CdcConfig.from_mapping({"enabled": True})), "id") == [(1,), (2,)]
    assert rows(apply_cdc(df, CdcConfig.from_mapping({"enabled": True, "mode": "sequence"})), "id") == [(1,), (2,)]
    assert rows(since_timestamp(df, lookback="1 day"), "id") == [(1,), (2,)]
    chosen = CdcConfig.from_mapping({"enabled": True, "mode": "sequence", "initial": -7})
    assert rows(apply_cdc(df, chosen), "id") == [(2,)]
