"""One small case from increment to dimension: parcels from two depots, weighed, classed, kept as history."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace import CdcConfig, Scd2Config, apply_cdc, scd2_merge, sql_block
from millrace.functions.transforms import python_step, register_transform

PARCEL = "parcel LONG, depot STRING, grams INT, scanned TIMESTAMP_NTZ"
STORED = ("parcel LONG, depot STRING, grams INT, tariff STRING, since TIMESTAMP_NTZ, until TIMESTAMP_NTZ, live BOOLEAN, n INT")
SCD2 = Scd2Config.from_mapping({"enabled": True, "key_columns": ["parcel"], "effective_date_column": "since",
                                "end_date_column": "until", "current_flag_column": "live", "version_column": "n"})
CURSOR, THEN, NOW = datetime(2031, 3, 1, 12), datetime(2030, 5, 5), datetime(2031, 3, 2)


@register_transform("tariff")
def tariff(df, steps):
    """The first step that is not exceeded names the tariff."""
    names = [F.when(F.col("grams") <= int(limit), name) for name, limit in steps.items()]
    return df.withColumn("depot", F.initcap("depot")).withColumn("tariff", F.coalesce(*names, F.lit("freight")))


STEPS = {"note": 50, "parcel": 2000}


@pytest.fixture
def increment(spark):
    north = spark.createDataFrame([(70, "north", 40, datetime(2031, 3, 1, 13)), (71, "north", 900, datetime(2031, 3, 1, 12)),
                                   (72, "north", 10, datetime(2031, 2, 1))], PARCEL)
    south = spark.createDataFrame([(80, "south", 5000, datetime(2031, 3, 1, 18)), (81, "south", 60, None)], PARCEL)
    cdc = CdcConfig.from_mapping({"enabled": True, "mode": "timestamp", "timestamp": {"column": "scanned"}})
    return apply_cdc(north, cdc, CURSOR).union(apply_cdc(south, cdc, CURSOR))


@pytest.fixture
def dimension(spark):
    return spark.createDataFrame([(70, "North", 1500, "parcel", THEN, None, True, 3),
                                  (71, "North", 900, "parcel", THEN, None, True, 1),
                                  (99, "West", 7, "note", THEN, None, True, 1)], STORED)


def test_rows_at_or_after_the_cursor(increment, rows):
    assert rows(increment, "parcel") == [(70,), (71,), (80,)]


def test_tariffs(increment, rows):
    out = increment.transform(python_step("tariff", {"steps": STEPS}))
    assert rows(out, "parcel", "depot", "tariff") == [(70, "North", "note"), (71, "North", "parcel"), (80, "South", "freight")]


@pytest.mark.parametrize("broadcast", [False, True])
def test_changed_new_equal_and_unseen_keys(increment, dimension, rows, broadcast):
    source = increment.transform(python_step("tariff", {"steps": STEPS}))
    out = scd2_merge(dimension, source, SCD2, NOW, broadcast_source=broadcast, check_target=True)
    assert rows(out, "parcel", "grams", "tariff", "since", "until", "live", "n") == sorted([
        (70, 1500, "parcel", THEN, NOW, False, 3), (70, 40, "note", NOW, None, True, 4),
        (71, 900, "parcel", THEN, None, True, 1), (80, 5000, "freight", NOW, None, True, 1),
        (99, 7, "note", THEN, None, True, 1)], key=repr)


def test_the_same_in_sql(increment, rows):
    out = sql_block(increment, """
        CREATE OR REPLACE TEMP VIEW weighed AS SELECT parcel, grams / 1000.0 AS kg FROM temp_table; -- kilograms
        SELECT parcel, kg > 1 AS heavy FROM weighed""")
    assert rows(out) == [(70, False), (71, False), (80, True)]
