from datetime import datetime

import pytest

from millrace.plans.run import run_flow
from millrace.plans.spec import flow
from millrace.sinks import deltas


@pytest.mark.parametrize("db_type, update", [
    ("mysql", "UPDATE `d`.`dim` t JOIN `d`.`new` s ON t.`k` = s.`k` AND t.`version` = s.`version` SET t.`v` = s.`v`"),
    ("postgresql", 'UPDATE "d"."dim" AS t SET "v" = s."v" FROM "d"."new" AS s WHERE t."k" = s."k" AND t."version" = s."version"'),
    ("mssql", "UPDATE t SET [v] = s.[v] FROM [d].[dim] AS t JOIN [d].[new] AS s ON t.[k] = s.[k] AND t.[version] = s.[version]")])
def test_statements(db_type, update):
    found = deltas.delta_statements(db_type, "d.dim", "d.new", ["k", "v", "version"], ["k", "version"])
    assert found[0] == update and len(found) == 2
    assert found[1].startswith("INSERT INTO") and "NOT EXISTS" in found[1]
    assert deltas.delta_statements(db_type, "t", "s", ["k"], ["k"])[0].startswith("INSERT")
    odd = deltas.delta_statements(db_type, "t", "s", ["a`b\"c]d"], ["a`b\"c]d"])[0]
    assert {"mysql": "`a``b\"c]d`", "postgresql": '"a`b""c]d"', "mssql": "[a`b\"c]]d]"}[db_type] in odd
    with pytest.raises(ValueError):
        deltas.delta_statements("oracle", "t", "s", ["k"], ["k"])


def test_statements_bring_changes_in_and_can_be_repeated():
    """The PostgreSQL form, run by an embedded engine that understands it: twice gives what once gives."""
    import duckdb

    db = duckdb.connect()
    db.sql("CREATE TABLE dim AS SELECT * FROM (VALUES (1, 1, 'a', true), (2, 1, 'b', true), (NULL, 1, 'n', true)) t(k, version, v, is_current)")
    db.sql("CREATE TABLE new AS SELECT * FROM (VALUES (1, 1, 'a', false), (1, 2, 'A', true), (3, 1, 'c', true), (NULL, 1, 'm', true)) t(k, version, v, is_current)")
    for _ in range(2):
        for text in deltas.delta_statements("postgresql", "dim", "new", ["k", "version", "v", "is_current"], ["k", "version"]):
            db.execute(text)
        assert sorted(db.sql("SELECT * FROM dim").fetchall(), key=repr) == sorted(
            [(1, 1, "a", False), (1, 2, "A", True), (2, 1, "b", True), (3, 1, "c", True), (None, 1, "n", True), (None, 1, "m", True)], key=repr)


class _Connection:
    def __init__(self, fail=False):
        self.said, self.fail = [], fail

    def __getattr__(self, name):
        def call(*args):
            self.said.append((name, *args))
            if self.fail and name == "executeUpdate":
                raise RuntimeError("lost")
            return self
        return call


def test_one_transaction_or_nothing():
    good, bad = _Connection(), _Connection(fail=True)
    deltas.run_in_transaction(good, ["u", "i"], "d")
    assert [s for s in good.said if s[0] != "close"] == [("setAutoCommit", False), ("createStatement",), ("executeUpdate", "u"), ("executeUpdate", "i"),
                                                         ("commit",), ("executeUpdate", "d"), ("commit",)]
    with pytest.raises(RuntimeError):
        deltas.run_in_transaction(bad, ["u", "i"], "d")
    assert [s[0] for s in bad.said[-2:]] == ["rollback", "close"]
    assert deltas.staging_name("s.dim", "0123456789abcdef") == "s.dim__delta_0123456789ab"


def test_catalog_loads_rewrite_open_rows_only(spark, folder, rows):
    feed, name = folder(), "type2_catalog"
    spec = flow("c").source("parquet", path=feed).target("table", table=name, scd2={"key_columns": ["k"], "time_type": "timestamp_ntz"}).spec()

    def load(data, year):
        spark.createDataFrame(data, "k INT, v STRING").write.mode("overwrite").parquet(feed)
        return run_flow(spark, spec, as_of=datetime(year, 1, 1)).frame

    def files():
        return {f.split("/")[-1] for f in spark.table(name).filter("NOT is_current").inputFiles()}

    load([(1, "a"), (2, "b"), (None, "n")], 2020)
    load([(1, "A")], 2021)
    before = files()
    out = load([(1, "AA"), (3, "c")], 2022)
    assert before and before < files()                                          # closed rows stay where they are
    want = [(1, "a", 1, False), (1, "A", 2, False), (1, "AA", 3, True), (2, "b", 1, True), (3, "c", 1, True), (None, "n", 1, True)]
    assert rows(out, "k", "v", "version", "is_current") == sorted(want, key=repr)
    spark.sql(f"DROP TABLE {name}")


def test_a_catalog_load_that_died_half_way_is_repeated(spark, folder, rows, monkeypatch):
    feed, name = folder(), "type2_halfway"
    spec = flow("c").source("parquet", path=feed).target("table", table=name, scd2={"key_columns": ["k"], "time_type": "timestamp_ntz"}).spec()
    spark.createDataFrame([(1, "a"), (2, "b")], "k INT, v STRING").write.parquet(feed)
    run_flow(spark, spec, as_of=datetime(2020, 1, 1))
    spark.createDataFrame([(1, "A")], "k INT, v STRING").write.mode("overwrite").parquet(feed)
    with monkeypatch.context() as patch:
        patch.setattr(type(spark), "sql", lambda self, *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            run_flow(spark, spec, as_of=datetime(2021, 1, 1))
    assert spark.table(name).count() == 3                                       # the closed row is there, the open one still, too
    out = run_flow(spark, spec, as_of=datetime(2021, 1, 1)).frame
    assert rows(out, "k", "v", "version", "is_current") == [(1, "A", 2, True), (1, "a", 1, False), (2, "b", 1, True)]
    spark.sql(f"DROP TABLE {name}")
