from datetime import datetime

import pytest
import yaml
from pyspark.sql import functions as F

from millrace import CursorStore, SnapshotFolder
from millrace.plans import run as run_module
from millrace.plans.run import build_increment, run_flow
from millrace.plans.spec import flow, load_connections, load_spec

SAMPLE = """
name: Harbour
source:
  type: mysql
  connection: quay
  config:
    table: arrivals
    cdc: {enabled: false, mode: timestamp, timestamp: {column: berthed_at}}
transformations:
  - type: sql
    config:
      query: |
        -- ships by length class
        CREATE OR REPLACE TEMP VIEW classed AS SELECT imo, length_m DIV 50 AS class FROM temp_table;
        SELECT * FROM classed;
  - type: python
target:
  type: jdbc
  connection: quay
  config: {db_type: mysql, table: arrivals_by_class, mode: append}
scheduler: cron
schedule_cron: "15 4 * * 1"
"""
CONNECTIONS = {"connections": {"mysql": {"quay": {
    "host": "db.harbour.test", "port": 3307, "database": "port", "user": "loader", "password": "${DB_PASSWORD}"}}}}


# -- specification -----------------------------------------------------------------------------

def test_sample(monkeypatch):
    monkeypatch.setenv("DB_PASSWORD", "s3cret")
    spec = load_spec(SAMPLE, CONNECTIONS)
    assert spec.name == "Harbour" and spec.sources[0].type == "mysql" and spec.target.type == "jdbc"
    assert spec.sources[0].config["host"] == "db.harbour.test" and spec.target.config["password"] == "s3cret"
    assert [t.type for t in spec.transforms] == ["sql", "python"]
    assert not spec.sources[0].cdc.enabled and spec.target.scd2 is None and spec.target.mode == "append"
    assert spec.schedule == {"scheduler": "cron", "schedule_cron": "15 4 * * 1"}
    assert "s3cret" not in repr(spec)


def test_from_files(tmp_path, monkeypatch):
    monkeypatch.setenv("DB_PASSWORD", "x")
    (tmp_path / "flow.yaml").write_text(SAMPLE)
    (tmp_path / "connections.yaml").write_text(yaml.safe_dump(CONNECTIONS))
    assert load_spec(tmp_path / "flow.yaml", tmp_path / "connections.yaml").name == "Harbour"
    with pytest.raises(FileNotFoundError):
        load_spec(tmp_path / "missing.yaml")
    assert load_connections(tmp_path / "missing.yaml") == {}


def test_connection_lookup(monkeypatch):
    monkeypatch.delenv("DB_PASSWORD", raising=False)
    with pytest.raises(ValueError, match="DB_PASSWORD is not set"):
        load_spec(SAMPLE, CONNECTIONS)
    with pytest.raises(ValueError, match="no connection 'quay' of type 'mysql'"):
        load_spec(SAMPLE)
    raw = yaml.safe_load(SAMPLE)
    raw["source"]["config"]["host"] = "elsewhere"
    known = {"mysql": {"quay": {"host": "a", "port": 1, "database": "d", "user": "u", "password": "p"}}}
    assert load_spec(raw, known).sources[0].config["host"] == "a"        # the connection wins
    raw["target"]["config"]["db_type"] = "postgresql"
    with pytest.raises(ValueError, match="of type 'postgresql'"):
        load_spec(raw, known)
    known["postgresql"] = {"quay": {**known["mysql"]["quay"], "host": "pg"}}
    assert load_spec(raw, known).target.config["host"] == "pg"


def _with(**changes):
    raw = {"source": {"type": "parquet", "config": {"path": "p"}},
           "target": {"type": "parquet", "config": {"path": "q"}}}
    for key, value in changes.items():
        raw[key] = value
    return raw


@pytest.mark.parametrize("changes, text", [
    ({"source": {}}, "source type"),
    ({"target": {}}, "target type"),
    ({"transformations": [{"type": "perl"}]}, "transformation type 'perl'"),
    ({"transformations": [{"type": "sql", "config": {}}]}, "needs a 'query'"),
    ({"transformations": [{"type": "sql", "config": {"query": "-- no transformation"}}]}, "holds no statement"),
    ({"transformations": [{"type": "python", "config": {"function": "f?"}}]}, "no transform is registered"),
    ({"source": {"type": "parquet", "config": {"path": "p", "cdc": {"enabled": True, "mode": "x"}}}}, "cdc mode"),
    ({"target": {"type": "parquet", "config": {"path": "q", "scd2": {"enabled": True}}}}, "at least one key"),
    ({"target": {"type": "parquet", "config": {"path": "q", "mode": "merge"}}}, "merge_keys"),
    ({"target": {"type": "parquet", "config": {"path": "q", "mode": "merge", "merge_keys": ["k"],
                                               "scd2": {"enabled": True, "key_columns": ["k"]}}}}, "merges by itself"),
    ({"combine": "zip"}, "combine"),
    ({"sources": [{"type": "parquet", "name": "a", "config": {"path": "p"}}] * 2}, "different names"),
])
def test_mistakes_are_found_at_load(changes, text):
    with pytest.raises(ValueError, match=text):
        load_spec(_with(**changes))


def test_unnamed_and_builder():
    assert load_spec(_with()).name == "UnnamedPipeline"
    built = (flow("b").source("parquet", path="p").sql("SELECT 1 AS a").python("not_null", columns="a")
             .target("csv", path="q", mode="overwrite").set(scheduler="cron"))
    spec = built.spec()
    assert spec == load_spec(built.to_yaml())
    assert spec.target.config["format"] == "csv" and spec.schedule == {"scheduler": "cron"}


# -- runs --------------------------------------------------------------------------------------

DAY = [datetime(2024, 1, d) for d in range(1, 9)]
DDL = "id INT, name STRING, ts TIMESTAMP_NTZ"


def feed(spark, path, data):
    spark.createDataFrame(data, DDL).coalesce(1).write.mode("append").parquet(path)


def cdc(state, **more):
    return {"enabled": True, "mode": "timestamp", "timestamp": {"column": "ts"}, "state": state, **more}


def test_append_without_state(spark, folder, rows):
    left, sink = folder(), folder()
    feed(spark, left, [(1, "a", DAY[0]), (2, None, DAY[1])])
    spec = (flow("f").source("parquet", path=left).python("not_null", columns=["name"])
            .sql("SELECT id, UPPER(name) AS name FROM temp_table").target("parquet", path=sink).spec())
    assert rows(build_increment(spark, spec)) == [(1, "A")]
    run_flow(spark, spec)
    result = run_flow(spark, spec)
    assert rows(spark.read.parquet(sink)) == [(1, "A"), (1, "A")]
    assert result.flow == "f" and result.cursors == {}


def test_cursor_moves_only_after_the_write(spark, folder, rows, monkeypatch):
    left, sink, state = folder(), folder(), folder()
    feed(spark, left, [(1, "a", DAY[0]), (2, "b", DAY[1])])
    spec = flow("f").source("parquet", path=left, cdc=cdc(state, inclusive=False)).target("parquet", path=sink).spec()
    with monkeypatch.context() as patch:
        patch.setattr(run_module, "write_plain", lambda *a: (_ for _ in ()).throw(RuntimeError("sink lost")))
        with pytest.raises(RuntimeError, match="sink lost"):
            run_flow(spark, spec)
    assert CursorStore(spark, state).get("f/source0", "ts") is None
    assert run_flow(spark, spec).cursors == {"f/source0": "2024-01-02 00:00:00"}
    run_flow(spark, spec)                                       # nothing new
    feed(spark, left, [(3, "c", DAY[2]), (4, "late", DAY[0]), (5, None, None)])
    run_flow(spark, spec)
    assert rows(spark.read.parquet(sink), "id") == [(1,), (2,), (3,)]


def test_two_sources_one_upsert_target(spark, folder, rows):
    left, right, sink, state = folder(), folder(), folder(), folder()
    feed(spark, left, [(1, "a", DAY[0])])
    feed(spark, right, [(2, "b", DAY[1])])
    spec = (flow("f").source("parquet", path=left, cdc=cdc(state), name="l")
            .source("parquet", path=right, cdc=cdc(state), name="r")
            .target("parquet", path=sink, mode="merge", merge_keys=["id"], order_by=["ts"]).spec())
    run_flow(spark, spec)
    once = rows(SnapshotFolder(spark, sink).read())
    run_flow(spark, spec)                                       # rows on the cursor come again, harmlessly
    assert rows(SnapshotFolder(spark, sink).read()) == once == [(1, "a", DAY[0]), (2, "b", DAY[1])]
    feed(spark, left, [(2, "B", DAY[3]), (3, "c", DAY[3])])
    out = run_flow(spark, spec).frame
    assert rows(out) == [(1, "a", DAY[0]), (2, "B", DAY[3]), (3, "c", DAY[3])]
    assert CursorStore(spark, state).get("f/l", "ts").startswith("2024-01-04")
    assert CursorStore(spark, state).get("f/r", "ts").startswith("2024-01-02")


@pytest.mark.parametrize("small", [True, False])
def test_two_runs_equal_one(spark, folder, rows, monkeypatch, small):
    """A then B through a dimension gives the same open rows as A and B at once."""
    monkeypatch.setattr("millrace.functions.workspace.BROADCAST_BYTES", 10**9 if small else -1)
    left, sink, state = folder(), folder(), folder()
    spec = (flow("f").source("parquet", path=left, cdc=cdc(state))
            .target("parquet", path=sink, scd2={"key_columns": ["id"], "order_by": ["ts"], "track": ["name"],
                                                "time_type": "timestamp_ntz"}).spec())
    feed(spark, left, [(1, "a", DAY[0]), (2, "b", DAY[1])])
    run_flow(spark, spec, as_of=DAY[5])
    feed(spark, left, [(2, "B", DAY[2]), (3, "c", DAY[2])])
    out = run_flow(spark, spec, as_of=DAY[6]).frame
    assert rows(out, "id", "name", "valid_from", "valid_to", "is_current", "version") == sorted([
        (1, "a", DAY[5], None, True, 1), (2, "b", DAY[5], DAY[6], False, 1), (2, "B", DAY[6], None, True, 2),
        (3, "c", DAY[6], None, True, 1)], key=repr)
    again = run_flow(spark, spec, as_of=DAY[7]).frame
    assert rows(again) == rows(out)


def test_closed_history_is_not_rewritten(spark, folder, rows):
    left, sink = folder(), folder()
    spec = (flow("f").source("parquet", path=left)
            .target("parquet", path=sink, scd2={"key_columns": ["id"], "order_by": ["ts"]}).spec())
    for n, name in enumerate("abc"):
        feed(spark, left, [(1, name, DAY[n])])
        run_flow(spark, spec, as_of=DAY[n])
    state = SnapshotFolder(spark, sink).snapshot()
    closed = [f for f, part in state.folders.items() if '"false"' in part]
    opened = [f for f, part in state.folders.items() if '"true"' in part]
    assert len(closed) == 2 and len(opened) == 1                # one folder per load that closed something
    assert rows(SnapshotFolder(spark, sink).read(), "name", "version") == [("a", 1), ("b", 2), ("c", 3)]


@pytest.mark.parametrize("kind", ["upsert", "scd2"])
def test_untouched_partitions_are_kept(spark, folder, rows, kind):
    left, sink = folder(), folder()
    how = ({"mode": "merge", "merge_keys": ["name", "id"]} if kind == "upsert" else
           {"scd2": {"key_columns": ["name", "id"], "time_type": "timestamp_ntz"}})
    spec = flow("f").source("parquet", path=left).target("parquet", path=sink, partition_by=["name"], **how).spec()
    feed(spark, left, [(1, "x", DAY[0]), (2, "y", DAY[0])])
    run_flow(spark, spec, as_of=DAY[4])
    before = SnapshotFolder(spark, sink).snapshot()
    left = folder()
    feed(spark, left, [(2, "y", DAY[1]), (3, "z", DAY[1])])
    spec = flow("f").source("parquet", path=left).target("parquet", path=sink, partition_by=["name"], **how).spec()
    out = run_flow(spark, spec, as_of=DAY[5]).frame
    after = SnapshotFolder(spark, sink).snapshot()
    kept = {f.split("/", 1)[1] for f in set(before.folders) & set(after.folders)}
    assert kept == ({"name=x"} if kind == "upsert" else {"name=x/is_current=true"})
    if kind == "upsert":
        assert rows(out) == [(1, "x", DAY[0]), (2, "y", DAY[1]), (3, "z", DAY[1])]
    else:
        assert rows(out, "id", "name", "ts", "is_current", "version") == sorted([
            (1, "x", DAY[0], True, 1), (2, "y", DAY[0], False, 1), (2, "y", DAY[1], True, 2), (3, "z", DAY[1], True, 1)],
            key=repr)


def test_a_plain_folder_becomes_a_dimension(spark, folder, rows):
    """An existing dimension written by something else is taken over at the first load."""
    left, sink = folder(), folder()
    spark.createDataFrame([(1, "a", DAY[0], None, True, 1)],
                          "id INT, name STRING, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ, is_current BOOLEAN, "
                          "version INT").write.parquet(sink)
    feed(spark, left, [(1, "b", DAY[1])])
    spec = flow("f").source("parquet", path=left).target("parquet", path=sink, scd2={"key_columns": ["id"]}).spec()
    out = run_flow(spark, spec, as_of=DAY[2]).frame
    assert rows(out) == sorted([(1, "a", DAY[0], DAY[2], False, 1), (1, "b", DAY[2], None, True, 2)], key=repr)


def test_plain_modes_on_a_committed_folder(spark, folder, rows):
    sink = folder()
    SnapshotFolder(spark, sink).commit(spark.range(2), partition_by=[])
    left = folder()
    spark.range(5, 6).write.parquet(left)

    def run(mode):
        return run_flow(spark, flow("f").source("parquet", path=left).target("parquet", path=sink, mode=mode).spec()).frame

    assert rows(run("ignore")) == [(0,), (1,)]
    assert rows(run("append")) == [(0,), (1,), (5,)]
    with pytest.raises(ValueError, match="already holds data"):
        run("error")
    assert rows(run("overwrite")) == [(5,)]


def test_change_log_flow(spark, folder, rows):
    sink = folder()

    def run(entries):
        left = folder()
        spark.createDataFrame(entries, "op STRING, seq LONG, id INT, v STRING").write.parquet(left)
        return run_flow(spark, flow("f").source("parquet", path=left, cdc={
            "enabled": True, "mode": "binlog", "binlog": {"keys": ["id"]}}).target("parquet", path=sink).spec()).frame

    assert rows(run([("I", 1, 1, "a"), ("I", 2, 2, "b")])) == [(1, "a"), (2, "b")]
    assert rows(run([("D", 3, 1, None), ("U", 4, 2, "B"), ("I", 5, 3, "c")])) == [(2, "B"), (3, "c")]


def test_catalog_table_target(spark, folder, rows):
    left = folder()
    feed(spark, left, [(1, "a", DAY[0])])
    spec = (flow("f").source("parquet", path=left)
            .target("table", table="dim_t", scd2={"key_columns": ["id"], "order_by": ["ts"]}).spec())
    run_flow(spark, spec, as_of=DAY[1])
    feed(spark, left, [(1, "b", DAY[2])])
    out = run_flow(spark, spec, as_of=DAY[3]).frame
    assert rows(out, "name", "is_current", "version") == [("a", False, 1), ("b", True, 2)]
    spark.sql("DROP TABLE dim_t")


def test_sources_by_position(spark, folder, rows):
    left, right, sink = folder(), folder(), folder()
    spark.range(1).selectExpr("id AS a").write.parquet(left)
    spark.range(5, 6).selectExpr("id AS b").write.parquet(right)
    built = (flow("f").source("parquet", path=left).source("parquet", path=right)
             .target("parquet", path=sink).set(combine="by_position"))
    assert rows(build_increment(spark, built.spec())) == [(0,), (5,)]
    with pytest.raises(Exception, match="(?i)column"):
        build_increment(spark, built.set(combine="by_name").spec())


def test_session_is_left_alone(spark, folder):
    left = folder()
    feed(spark, left, [(1, "a", DAY[0])])
    run_flow(spark, flow("f").source("parquet", path=left).sql(
        "CREATE OR REPLACE TEMP VIEW mine AS SELECT * FROM temp_table; SELECT * FROM mine")
        .target("parquet", path=folder()).spec())
    assert spark.range(1).select(F.lit(1)).count() == 1
    assert not [t for t in spark.catalog.listTables() if t.isTemporary]


# -- loads that must neither lose nor double rows ---------------------------------------------------

def _dimension(feed, sink, **more):
    return (flow("d").source("parquet", path=feed, schema="k INT, v STRING")
            .target("parquet", path=sink, scd2={"key_columns": ["k"], "time_type": "timestamp_ntz"}, **more).spec())


def test_history_is_not_scanned_when_every_key_is_open(spark, folder, rows, monkeypatch):
    """Own loads note that no key has closed rows alone; then no folder of closed rows is opened by a load."""
    feed, sink, asked = folder(), folder(), []
    read = SnapshotFolder.read
    monkeypatch.setattr(SnapshotFolder, "read", lambda self, parts=None, at=None: asked.append(parts) or read(self, parts, at))
    for n, value in enumerate("abc"):
        spark.createDataFrame([(1, value), (2, "same")], "k INT, v STRING").write.mode("overwrite").parquet(feed)
        asked.clear()
        out = run_flow(spark, _dimension(feed, sink), as_of=datetime(2020 + n, 1, 1)).frame
    assert [p for p in asked if p] == [{'{"is_current":"true"}'}]
    assert rows(out, "k", "v", "version") == [(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "same", 1)]


def test_foreign_dimension_numbers_on(spark, folder, rows):
    feed, sink = folder(), folder()
    spark.createDataFrame([(1, "old", datetime(2019, 1, 1), datetime(2019, 6, 1), False, 4)],
                          "k INT, v STRING, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ, is_current BOOLEAN, version INT"
                          ).write.parquet(sink)
    for n, key in enumerate((2, 1)):
        spark.createDataFrame([(key, "new")], "k INT, v STRING").write.mode("overwrite").parquet(feed)
        out = run_flow(spark, _dimension(feed, sink), as_of=datetime(2020 + n, 1, 1)).frame
    assert rows(out, "k", "v", "version") == [(1, "new", 5), (1, "old", 4), (2, "new", 1)]


@pytest.mark.parametrize("limit", [-1, 1 << 40])
def test_a_broken_target_fails_alike_whatever_the_size(spark, folder, limit):
    feed, sink = folder(), folder()
    spark.createDataFrame([(1, "a", datetime(2019, 1, 1), None, True, n) for n in (1, 2)],
                          "k INT, v STRING, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ, is_current BOOLEAN, version INT"
                          ).write.parquet(sink)
    spark.createDataFrame([(1, "b")], "k INT, v STRING").write.parquet(feed)
    with pytest.raises(Exception, match="repeated key in open rows"):
        run_flow(spark, _dimension(feed, sink, broadcast_bytes=limit), as_of=datetime(2020, 1, 1))


def test_self_overwrite_keeps_the_rows(spark, folder, rows):
    path = folder()
    spark.range(5).write.parquet(path)
    spec = flow("o").source("parquet", path=path).sql("SELECT id + 1 AS id FROM temp_table").target("parquet", path=path, mode="overwrite").spec()
    assert rows(run_flow(spark, spec).frame) == [(i,) for i in range(1, 6)]
    assert rows(spark.read.parquet(path)) == [(i,) for i in range(1, 6)]


def test_a_committed_target_is_a_source(spark, folder, rows):
    feed, middle = folder(), folder()
    spark.range(3).write.parquet(feed)
    first = flow("a").source("parquet", path=feed).target("parquet", path=middle, mode="merge", merge_keys=["id"]).spec()
    run_flow(spark, first)
    run_flow(spark, first)
    second = flow("b").source("parquet", path=middle).target("parquet", path=folder(), mode="overwrite").spec()
    out = build_increment(spark, second)
    assert out.columns == ["id"] and rows(out) == [(0,), (1,), (2,)]
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        spark.read.parquet(middle)


def test_append_with_an_inclusive_cursor_is_refused(folder):
    cdc = {"enabled": True, "mode": "timestamp", "timestamp": {"column": "ts"}, "state": folder()}
    with pytest.raises(ValueError, match="inclusive: false"):
        flow("a").source("parquet", path="x", cdc=cdc).target("parquet", path="y").spec()
    flow("a").source("parquet", path="x", cdc={**cdc, "inclusive": False}).target("parquet", path="y").spec()
    flow("a").source("parquet", path="x", cdc=cdc).target("parquet", path="y", mode="merge", merge_keys=["k"]).spec()


def test_change_log_cursor(spark, folder, rows, monkeypatch):
    """The second run stages new entries only, and an entry that arrives late with an old number changes nothing."""
    feed, sink, staged = folder(), folder(), []
    stage = run_module.stage
    monkeypatch.setattr(run_module, "stage", lambda *a, **k: staged.append(stage(*a, **k)) or staged[-1])
    spec = (flow("log").source("parquet", path=feed, cdc={"enabled": True, "mode": "binlog", "binlog": {"keys": ["k"]}, "state": folder()})
            .target("parquet", path=sink).spec())
    ddl = "k INT, v STRING, op STRING, seq LONG"
    spark.createDataFrame([(1, "a", "I", -3), (2, "b", "I", 4), (1, "c", "U", 5)], ddl).write.parquet(feed)
    assert rows(run_flow(spark, spec).frame) == [(1, "c"), (2, "b")]
    spark.createDataFrame([(1, "late", "U", 2), (2, None, "D", 6), (3, "d", "I", 7)], ddl).write.mode("append").parquet(feed)
    assert rows(run_flow(spark, spec).frame) == [(1, "c"), (3, "d")]
    assert [s.rows for s in staged] == [3, 2]


def test_staged_copies_go_after_the_load(spark, folder, monkeypatch):
    feed, staged = folder(), []
    stage = run_module.stage
    monkeypatch.setattr(run_module, "stage", lambda *a, **k: staged.append(stage(*a, **k)) or staged[-1])
    spark.range(3).write.parquet(feed)
    run_flow(spark, flow("a").source("parquet", path=feed).target("parquet", path=folder(), mode="merge", merge_keys=["id"]).spec())
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged[0].path)
    assert not store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store)


def test_compaction_and_orphans(spark, folder, rows):
    feed, sink = folder(), folder()
    spec = flow("a").source("parquet", path=feed).target("parquet", path=sink, mode="merge", merge_keys=["id"]).spec()
    assert run_module.compact_target(spark, spec) is None
    spark.range(30).repartition(6).write.parquet(feed)
    run_flow(spark, spec)
    spark.range(1).write.parquet(f"{sink}/_loads/load=000009-died")
    assert SnapshotFolder(spark, sink).orphans() == ["load=000009-died"]
    out = run_module.compact_target(spark, spec)
    assert out.count() == 30 and len(out.inputFiles()) == 1


def test_external_table_takes_a_second_merge(spark, folder, rows):
    where, feed = folder(), folder()
    for top in (3, 5):
        spark.range(top).write.mode("overwrite").parquet(feed)
        spec = (flow("t").source("parquet", path=feed)
                .target("table", table="external_merge", options={"path": where}, mode="merge", merge_keys=["id"]).spec())
        out = run_flow(spark, spec).frame
    assert rows(out) == [(i,) for i in range(5)]
    spark.sql("DROP TABLE external_merge")


# -- buckets, notes, overwrites ------------------------------------------------------------------------

def test_an_increment_reaches_its_buckets_only(spark, folder, rows):
    feed, sink = folder(), folder()
    ddl = "k STRING, v STRING"
    for settings in ({"mode": "merge", "merge_keys": ["k"]}, {"scd2": {"key_columns": ["k"], "time_type": "timestamp_ntz"}}):
        sink = folder()
        spec = flow("b").source("parquet", path=feed, schema=ddl).target("parquet", path=sink, buckets=8, **settings).spec()
        spark.createDataFrame([(str(n) if n else None, "old") for n in range(60)], ddl).write.mode("overwrite").parquet(feed)
        run_flow(spark, spec, as_of=datetime(2020, 1, 1))
        before = SnapshotFolder(spark, sink).snapshot()
        spark.createDataFrame([("7", "new"), (None, "new")], ddl).write.mode("overwrite").parquet(feed)
        out = run_flow(spark, spec, as_of=datetime(2030, 1, 1)).frame
        after = SnapshotFolder(spark, sink).snapshot()
        fresh = {f.split("/")[1] for f in set(after.folders) - set(before.folders)}
        gone = set(before.folders) - set(after.folders)
        assert len(gone) == 1 and len(fresh) == 2 and "__bucket=-1" in fresh       # one bucket rewritten; the NULL key was added to its own
        assert out.filter("v = 'new'").count() == 2 and out.filter("k IS NULL").count() == 2
        assert out.count() == 61 + ("scd2" in settings)
        # The scan of a load's target is limited to that bucket.
        reached = run_module._reached_parts(spec, spark.createDataFrame([("7", "x")], ddl), after)
        files = SnapshotFolder(spark, sink).read(reached, after).inputFiles()
        assert files and len({f.split("__bucket=")[1].split("/")[0] for f in files}) == 1


def test_other_bucket_numbers_rewrite_the_target(spark, folder, rows):
    feed, sink = folder(), folder()
    spark.range(20).write.parquet(feed)
    for n in (None, 4, 6, None):
        settings = {} if n is None else {"buckets": n}
        spec = flow("n").source("parquet", path=feed).target("parquet", path=sink, mode="merge", merge_keys="id", **settings).spec()
        assert rows(run_flow(spark, spec).frame) == sorted([(k,) for k in range(20)], key=repr)
    spark.range(20, 22).write.mode("overwrite").parquet(feed)
    run_flow(spark, flow("a").source("parquet", path=feed).target("parquet", path=sink, buckets=3, mode="merge", merge_keys="id").spec())
    run_flow(spark, flow("a").source("parquet", path=feed).target("parquet", path=sink, mode="append").spec())
    assert SnapshotFolder(spark, sink).read().count() == 24


@pytest.mark.parametrize("between", ["append", "log"])
def test_versions_go_on_after_other_writers(spark, folder, rows, between):
    """What closes rows without opening others makes later type 2 loads look at history again."""
    feed, sink = folder(), folder()

    def load(value, moment):
        spark.createDataFrame([(1, value)], "k INT, v STRING").write.mode("overwrite").parquet(feed)
        return run_flow(spark, _dimension(feed, sink), as_of=moment).frame

    load("a", datetime(2020, 1, 1))
    load("b", datetime(2021, 1, 1))
    rest = "v STRING, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ, is_current BOOLEAN"
    if between == "append":
        spark.createDataFrame([(9, "x", datetime(2019, 1, 1), datetime(2019, 2, 1), False, 5)], f"k INT, {rest}, version INT").write.mode("overwrite").parquet(feed)
        run_flow(spark, flow("more").source("parquet", path=feed).target("parquet", path=sink, mode="append").spec())
        spark.createDataFrame([(9, "y")], "k INT, v STRING").write.mode("overwrite").parquet(feed)
        out = run_flow(spark, _dimension(feed, sink), as_of=datetime(2022, 1, 1)).frame
        assert rows(out.filter("k = 9"), "v", "version") == [("x", 5), ("y", 6)]
    else:
        log = spark.createDataFrame([("D", 1, 1, 2)], "op STRING, seq INT, k INT, version INT").select("op", "seq", "k", "version", *[
            F.lit(None).cast(t).alias(n) for n, t in (("v", "string"), ("valid_from", "timestamp_ntz"), ("valid_to", "timestamp_ntz"), ("is_current", "boolean"))])
        log.write.mode("overwrite").parquet(feed)
        run_flow(spark, flow("log").source("parquet", path=feed, cdc={"enabled": True, "mode": "binlog", "binlog": {"keys": ["k", "version"]}})
                 .target("parquet", path=sink, partition_by=["is_current"]).spec())
        assert rows(load("c", datetime(2022, 1, 1)), "v", "version") == [("a", 1), ("c", 2)]


def test_an_overwrite_that_fails_keeps_the_old_rows(spark, folder, rows):
    feed, sink = folder(), folder()
    spark.range(3).write.parquet(feed)
    spark.range(10, 12).write.parquet(sink)
    spec = flow("o").source("parquet", path=feed).sql("SELECT assert_true(id < 2) AS x, id FROM temp_table").target("parquet", path=sink, mode="overwrite").spec()
    with pytest.raises(Exception):
        run_flow(spark, spec)
    assert rows(spark.read.parquet(sink)) == [(10,), (11,)]
    run_flow(spark, flow("o").source("parquet", path=feed).target("parquet", path=sink, mode="overwrite").spec())
    assert rows(spark.read.parquet(sink)) == [(0,), (1,), (2,)]


def test_partitions_can_be_overwritten_alone(spark, folder, rows):
    feed, sink = folder(), folder()
    spark.createDataFrame([(1, "a"), (2, "b")], "id INT, kind STRING").write.partitionBy("kind").parquet(sink)
    spark.createDataFrame([(3, "b")], "id INT, kind STRING").write.parquet(feed)
    spec = flow("p").source("parquet", path=feed).target("parquet", path=sink, mode="overwrite", partition_by=["kind"], options={"partitionOverwriteMode": "dynamic"}).spec()
    assert rows(run_flow(spark, spec).frame, "id", "kind") == [(1, "a"), (3, "b")]


def test_settings_of_layout_and_deletes_are_checked():
    def target(**config):
        return flow("t").source("parquet", path="p").target("parquet", path="q", **config)

    for bad in ({"buckets": 4}, {"buckets": 0, "mode": "merge", "merge_keys": "k"}, {"buckets": "4", "mode": "merge", "merge_keys": "k"}):
        with pytest.raises(ValueError, match="buckets"):
            target(**bad).spec()
    with pytest.raises(ValueError, match="full sources"):
        (flow("t").source("parquet", path="p", cdc={"enabled": True, "timestamp": {"column": "c"}})
         .target("parquet", path="q", scd2={"key_columns": ["k"], "deletes": "close"}).spec())
    with pytest.raises(ValueError, match="backdated"):
        flow("t").source("parquet", path="p").target("iceberg", path="q", scd2={"key_columns": ["k"], "backdated": True}).spec()
