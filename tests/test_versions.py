import re

import pytest

from millrace import append_if_changed, at_version, changed_versions, latest, version_history
from millrace.operators.versions import text_digest

DDL = "name STRING, version INT, body STRING"


def test_saving_a_text_again_and_again(spark, rows):
    """First save -> 1; same text, also with outer blanks -> still 1; changed -> 2; the first text again -> 3."""
    history = spark.createDataFrame([], DDL)
    for body, newest in (("a: 1", 1), ("a: 1", 1), ("\n a: 1\t\xa0", 1), ("a: 2", 2), ("a: 1", 3)):
        incoming = spark.createDataFrame([("flow", body)], "name STRING, body STRING")
        history = spark.createDataFrame(append_if_changed(history, incoming, "name", "body").collect(), DDL)
        assert latest(history, "name").first()["version"] == newest
    assert rows(version_history(history, "name"), "version", "body") == [(1, "a: 1"), (2, "a: 2"), (3, "a: 1")]
    assert [r["version"] for r in version_history(history, "name").collect()] == [3, 2, 1]
    assert rows(at_version(history, 2), "body") == [("a: 2",)]
    assert rows(at_version(history, 9)) == []


def test_nulls(spark, rows):
    history = spark.createDataFrame([("a", 1, None), ("b", 4, "x"), (None, 1, "y")], DDL)
    incoming = spark.createDataFrame([("a", None), ("b", None), (None, "y"), ("c", "new")], "name STRING, body STRING")
    assert rows(changed_versions(history, incoming, "name", "body"), "name", "body", "version") == sorted(
        [("b", None, 5), (None, "y", 1), ("c", "new", 1)], key=repr)


def test_repeated_incoming(spark, rows):
    history = spark.createDataFrame([], DDL)
    incoming = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "name STRING, body STRING, at INT")
    with pytest.raises(Exception, match="repeated key in incoming versions"):
        append_if_changed(history, incoming, "name", "body").collect()
    assert rows(append_if_changed(history, incoming, "name", "body", order_by="at")) == [("a", 1, "y")]


def test_extra_columns(spark):
    history = spark.createDataFrame([("a", 1, "x", "u")], DDL + ", author STRING")
    incoming = spark.createDataFrame([("a", "z")], "name STRING, body STRING")
    out = append_if_changed(history, incoming, "name", "body")
    assert out.columns == history.columns
    assert out.filter("version = 2").first()["author"] is None


def test_old_texts_stay_put(spark, folder):
    """Old texts are reduced to a digest before the shuffle."""
    old, new = folder(), folder()
    spark.createDataFrame([("a", 1, "x")], DDL).write.parquet(old)
    spark.createDataFrame([("a", "y")], "name STRING, body STRING").write.parquet(new)
    plan = changed_versions(spark.read.parquet(old), spark.read.parquet(new), "name", "body")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "sha2" in text and "row_number(), 1, Partial" in text


def test_a_kept_digest_spares_the_old_texts(spark, folder, rows):
    path = folder()
    history = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k INT, text STRING, version INT")
    history.withColumn("digest", text_digest("text")).write.parquet(path)
    incoming = spark.createDataFrame([(1, " a "), (2, "c"), (3, "d")], "k INT, text STRING")
    kept = spark.read.parquet(path)
    added = changed_versions(kept, incoming, "k", "text", digest="digest")
    assert rows(added, "k", "text", "version") == [(2, "c", 2), (3, "d", 1)]
    assert added.where("digest IS NULL").count() == 0
    scans = re.findall(r"ReadSchema: (struct<[^>]*>)", added._jdf.queryExecution().executedPlan().toString())
    assert scans and all("text" not in s for s in scans)
    whole = append_if_changed(kept, incoming, "k", "text", digest="digest")
    assert rows(changed_versions(whole, incoming, "k", "text", digest="digest")) == []
