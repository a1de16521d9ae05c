from datetime import datetime

import pytest

from millrace.streaming.windows import Windows, stream_windows, windowed

DDL = "k STRING, at TIMESTAMP_NTZ, v INT"


def at(hour, minute=0):
    return datetime(2024, 5, 1, hour, minute)


def test_late_rows_are_dropped_and_counted(spark, folder, rows):
    feed, target, checkpoint = folder(), folder(), folder()

    def arrive(*data):
        spark.createDataFrame(data, DDL).coalesce(1).write.mode("append").parquet(feed)
        return stream_windows(spark, feed, DDL, "at", Windows(size="1 hour"), {"n": "count(*)", "v": "sum(v)"}, target=target, checkpoint=checkpoint,
                              keys="k", delay="30 minutes")

    first = arrive(("a", at(1, 5), 1), ("a", at(1, 50), 2), ("b", at(2, 10), 4), (None, at(1, 30), 8), ("a", None, 99))
    assert rows(first.frame) == [] and first.late == 0 and first.rows_read == 5          # the watermark stands at 1:40
    second = arrive(("a", at(1, 59), 16), ("b", at(3, 0), 32))                           # not too late; then it stands at 2:30
    want = [("a", at(1), at(2), 3, 19), (None, at(1), at(2), 1, 8)]
    assert rows(second.frame) == sorted(want, key=repr) and second.late == 0
    third = arrive(("a", at(1, 58), 64), ("c", at(0, 1), 128), ("b", at(2, 59), 256), ("b", at(6), 1))
    assert third.late == 2                                                               # two windows are closed already
    want += [("b", at(2), at(3), 2, 260), ("b", at(3), at(4), 1, 32)]
    assert rows(third.frame) == sorted(want, key=repr)
    again = stream_windows(spark, feed, DDL, "at", Windows(size="1 hour"), {"n": "count(*)", "v": "sum(v)"}, target=target, checkpoint=checkpoint,
                           keys="k", delay="30 minutes")
    assert again.rows_read == 0 and rows(again.frame) == rows(third.frame)               # nothing is written twice


def test_tables_take_the_same_windows(spark, rows):
    df = spark.createDataFrame([("a", at(1), 1), ("a", at(1, 59), 2), ("a", at(4), 4)], DDL)
    assert rows(windowed(df, "at", Windows(gap="1 hour"), {"v": "sum(v)"}, "k")) == [("a", at(1), at(2, 59), 3), ("a", at(4), at(5), 4)]
    assert len(rows(windowed(df, "at", Windows(size="2 hours", slide="1 hour"), {"v": "sum(v)"}))) == 4
    for bad in ({}, {"size": "1 hour", "gap": "1 hour"}, {"gap": "1 hour", "slide": "1 hour"}):
        with pytest.raises(ValueError):
            Windows(**bad)
