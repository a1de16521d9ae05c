import pytest
from pyspark.errors import AnalysisException

from millrace.functions import workspace
from millrace.functions.workspace import Staged, shared_folder, stage
from millrace.sinks import check_target, target_config, write_plain
from millrace.sinks.files import jdbc_write_options, recover_table, replace_table, write_files, write_table
from millrace.sources import check_source, read_source, read_target, reading_settings
from millrace.sources.jdbc import bounds_query, check_jdbc_source, exists_query, relation, scan_options

DB = {"host": "h", "port": 1, "database": "d", "user": "u", "password": "p"}


# -- files -------------------------------------------------------------------------------------

def test_csv_is_all_text_without_options(spark, folder, rows):
    path = folder()
    write_files(spark.createDataFrame([(1, "a")], "id INT, name STRING"), path, "csv")
    out = read_source(spark, "S3", {"path": path, "format": "CSV"})
    assert out.dtypes == [("_c0", "string"), ("_c1", "string")] and rows(out) == [("1", "a")]


def test_csv_with_header_and_schema(spark, folder, rows):
    path, df = folder(), spark.createDataFrame([(1, "a"), (2, None)], "id INT, name STRING")
    write_files(df, path, "csv", options={"header": True})
    out = read_source(spark, "csv", {"path": path, "options": {"header": True}, "schema": "id INT, name STRING"})
    assert rows(out) == rows(df)


@pytest.mark.parametrize("mode, expected", [("append", 4), ("overwrite", 1), ("ignore", 3)])
def test_save_modes(spark, folder, mode, expected):
    path = folder()
    write_plain(spark.range(3), "parquet", {"path": path, "format": "parquet"})
    write_plain(spark.range(1), "parquet", {"path": path, "format": "parquet", "mode": mode})
    assert spark.read.parquet(path).count() == expected


@pytest.mark.parametrize("mode", ["error", "errorifexists", "default"])
def test_modes_that_refuse(spark, folder, mode):
    path = folder()
    config = {"path": path, "format": "parquet", "mode": mode}
    write_plain(spark.range(3), "s3", config)
    with pytest.raises(AnalysisException):
        write_plain(spark.range(1), "s3", config)


def test_pruning_and_pushdown(spark, folder):
    path = folder()
    spark.range(9).selectExpr("id", "id * 2 AS a", "id * 3 AS b").write.parquet(path)
    plan = read_source(spark, "parquet", {"path": path}).filter("a > 3").select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,3)" in text and "ReadSchema: struct<id:bigint,a:bigint>" in text


def test_target_that_is_not_there(spark, folder):
    assert read_target(spark, "parquet", {"path": folder(), "format": "parquet"}) is None
    assert read_target(spark, "table", {"table": "no_such_table"}) is None
    path = folder()
    spark.range(1).selectExpr("'x' AS t").write.text(path)
    with pytest.raises(Exception, match="FAILED_READ_FILE|CANNOT_READ_FILE_FOOTER"):     # there, but broken
        read_target(spark, "parquet", {"path": path, "format": "parquet"})


def test_target_read_back_with_its_options(spark, folder, rows):
    config = {"path": folder(), "format": "csv", "options": {"header": "true"}}
    write_plain(spark.createDataFrame([("a",)], "name STRING"), "s3", config)
    assert read_target(spark, "s3", config).columns == ["name"]


def test_hot_partition_value_is_split(spark, folder):
    path = folder()
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, id % 10, -1) AS p")
    write_files(df, path, "parquet", partition_by=["p"])
    assert spark.read.parquet(path).count() == 1000
    plan = df.hint("rebalance", "p")._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan


# -- catalog tables ----------------------------------------------------------------------------

def test_tables(spark, rows):
    write_table(spark.createDataFrame([(1, "a")], "id INT, v STRING"), "tt", "append")
    write_table(spark.createDataFrame([("b", 2)], "v STRING, id INT"), "tt", "append")
    assert rows(read_source(spark, "table", {"table": "tt"})) == [(1, "a"), (2, "b")]
    replace_table(spark.table("tt").filter("id = 2"), "tt")
    assert rows(spark.table("tt")) == [(2, "b")]
    assert not spark.catalog.tableExists("tt__old") and not spark.catalog.tableExists("tt__new")
    spark.sql("ALTER TABLE tt RENAME TO tt__old")                # a swap that died half way
    assert rows(read_target(spark, "table", {"table": "tt"})) == [(2, "b")]
    recover_table(spark, "tt")
    spark.sql("DROP TABLE tt")


def test_iceberg_needs_its_jar(spark):
    config = {"path": "cat.db.t"}
    check_target("iceberg", config)
    with pytest.raises(Exception, match="(?i)iceberg"):
        read_source(spark, "iceberg", config)
    with pytest.raises(Exception, match="(?i)iceberg"):
        write_plain(spark.range(1), "iceberg", config)


# -- jdbc: everything short of a database ------------------------------------------------------

@pytest.mark.parametrize("kind, url, driver", [
    ("mysql", "jdbc:mysql://h:1/d", "com.mysql.cj.jdbc.Driver"),
    ("postgresql", "jdbc:postgresql://h:1/d", "org.postgresql.Driver"),
    ("mssql", "jdbc:sqlserver://h:1;databaseName=d", "com.microsoft.sqlserver.jdbc.SQLServerDriver")])
def test_addresses(kind, url, driver):
    options = scan_options({**DB, "db_type": kind, "query": "SELECT 1"})
    assert (options["url"], options["driver"], options["user"], options["password"]) == (url, driver, "u", "p")
    written = jdbc_write_options({**DB, "db_type": kind, "table": "t"})
    assert (written["url"], written["driver"], written["dbtable"]) == (url, driver, "t")


def test_scan_options():
    config = {**DB, "query": "SELECT * FROM r", "fetchsize": 500, "partition_column": "id", "lower_bound": 0,
              "upper_bound": 100, "num_partitions": 4}
    options = scan_options(config)
    assert options["dbtable"] == "(SELECT * FROM r) q" == relation(config)
    assert (options["partitionColumn"], options["lowerBound"], options["upperBound"], options["numPartitions"],
            options["fetchsize"]) == ("id", "0", "100", "4", "500")
    assert bounds_query(config) == "SELECT MIN(id) AS lo, MAX(id) AS hi FROM (SELECT * FROM r) q"
    plain = scan_options({**DB, "query": "SELECT 1;"})
    assert plain["query"] == "SELECT 1" and "dbtable" not in plain
    assert scan_options({**DB, "table": "t"})["dbtable"] == "t"
    assert scan_options({**DB, "query": "q", "predicates": ["a = 1"]})["dbtable"] == "(q) q"
    assert exists_query({**DB, "table": "s.t'x"}).endswith("table_name = 't''x' AND table_schema = 's'")
    assert exists_query({**DB, "table": "t"}).endswith("table_schema = 'd'")


def test_write_options():
    options = jdbc_write_options({**DB, "table": "t", "truncate": True, "batchsize": 10, "num_partitions": 8,
                                  "create_table_column_types": "a VARCHAR(9)"})
    assert (options["truncate"], options["batchsize"], options["numPartitions"], options["createTableColumnTypes"]) == (
        "true", "10", "8", "a VARCHAR(9)")


def test_db_alias_on_both_sides():
    config = {k: v for k, v in DB.items() if k != "database"} | {"db": "d", "table": "t"}
    check_source("mysql", config)
    check_target("jdbc", config)


# -- configuration errors ----------------------------------------------------------------------

@pytest.mark.parametrize("kind, config, text", [
    ("oracle", {}, "source type"), (None, {}, "source type"),
    ("s3", {"format": "csv"}, "needs a 'path'"), ("s3", {"path": "p"}, "needs a 'format'"),
    ("s3", {"path": "p", "format": "orc"}, "needs a 'format'"),
    ("s3", {"path": "p", "format": "csv", "options": ["x"]}, "must be a mapping"),
    ("mysql", {**DB}, "exactly one of 'query' and 'table'"),
    ("mysql", {**DB, "query": "q", "table": "t"}, "exactly one"),
    ("postgresql", {"query": "q"}, "lacks host, port, user, password, database"),
    ("mssql", {**DB, "password": None, "query": "q"}, "lacks password"),
    ("mysql", {**DB, "table": "t", "partition_column": "id"}, "num_partitions"),
    ("mysql", {**DB, "table": "t", "lower_bound": 1}, "need 'partition_column'"),
    ("mysql", {**DB, "table": "t", "partition_column": "id", "num_partitions": 2, "predicates": ["a"]}, "not both"),
    ("jdbc", {"url": "jdbc:x", "table": "t"}, "needs 'driver'"),
    ("jdbc", {**DB, "db_type": "db2", "table": "t"}, "db_type"),
    ("table", {}, "needs 'table'"), ("iceberg", {}, "needs 'path'"), ("snapshot", {}, "needs 'path'"),
])
def test_source_errors(kind, config, text):
    with pytest.raises(ValueError, match=text):
        check_source(kind, config)


@pytest.mark.parametrize("kind, config, text", [
    ("kafka", {}, "target type"),
    ("s3", {"format": "csv"}, "needs a 'path'"), ("s3", {"path": "p"}, "needs a 'format'"),
    ("s3", {"path": "p", "format": "json"}, "needs a 'format'"),
    ("parquet", {"path": "p", "mode": "upsert"}, "mode 'upsert'"),
    ("parquet", {"path": "p", "mode": "merge"}, "needs 'merge_keys'"),
    ("iceberg", {}, "needs a 'path'"), ("iceberg", {"path": "t", "mode": "ignore"}, "mode 'ignore'"),
    ("iceberg", {"path": "t", "mode": "merge"}, "needs 'merge_keys'"),
    ("jdbc", {**DB}, "lacks table"), ("jdbc", {**DB, "table": "t", "mode": "merge"}, "mode 'merge'"),
    ("jdbc", {"table": "t"}, "lacks host"), ("jdbc", {**DB, "table": "t", "db_type": "db2"}, "db_type"),
    ("table", {}, "needs a 'table'"),
])
def test_target_errors(kind, config, text):
    with pytest.raises(ValueError, match=text):
        check_target(kind, config)


def test_format_from_the_type():
    assert target_config("csv", {"path": "p"})["format"] == "csv"


# -- shared folder -----------------------------------------------------------------------------

def test_shared_folder_is_the_sessions(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "x").startswith(root + "/millrace/x-")
    assert shared_folder(spark) != shared_folder(spark)


def test_staging_measures_and_cuts_lineage(spark, rows):
    df = spark.range(100).selectExpr("id", "repeat('x', 50) AS t")
    staged = stage(df)
    assert staged.rows == 100 and 5000 < staged.bytes < 20000 and staged.small
    assert rows(staged.frame) == rows(df)
    assert "Range" not in staged.frame._jdf.queryExecution().toString()
    empty = stage(df.limit(0))
    assert empty.rows == 0 and empty.bytes == 0 and empty.frame.columns == ["id", "t"]


def test_write_parallelism_does_not_split_the_read_back():
    target = {**DB, "db_type": "mysql", "table": "t", "num_partitions": 8}
    assert "numPartitions" in jdbc_write_options(target)
    again = reading_settings(target)
    check_jdbc_source(again)
    assert "num_partitions" not in again
    assert reading_settings({**target, "partition_column": "id"})["num_partitions"] == 8


def test_staged_sizes(spark):
    wide = spark.range(1000).selectExpr("transform(sequence(1, 100), x -> cast(x AS DOUBLE)) AS v")
    assert stage(wide).bytes == 800_000
    assert not stage(wide, limit=1000).small and stage(wide).small
    assert not Staged(wide, rows=workspace.BROADCAST_ROWS + 1, bytes=8).small


def test_a_table_overwrite_that_fails_keeps_the_old_rows(spark, rows):
    write_table(spark.range(3), "safe", "overwrite")
    failing = spark.range(5).selectExpr("id", "assert_true(id < 2) AS x").selectExpr("coalesce(x, id) AS id")
    with pytest.raises(Exception):
        write_table(failing, "safe", "overwrite")
    assert rows(spark.table("safe")) == [(0,), (1,), (2,)]
    write_table(spark.table("safe").selectExpr("id + 10 AS id"), "safe", "overwrite")       # from the table itself
    assert rows(spark.table("safe")) == [(10,), (11,), (12,)]
    spark.sql("DROP TABLE safe")


def test_partitions_of_a_table_are_overwritten_alone(spark, rows):
    dynamic = {"partitionOverwriteMode": "dynamic"}
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id INT, kind STRING")
    write_table(first, "parts", "overwrite", options=dynamic, partition_by=["kind"])
    # Columns by name, a NULL partition, a new one.
    news = spark.createDataFrame([("b", 20), (None, 30), ("c", 40)], "kind STRING, id INT")
    write_table(news, "parts", "overwrite", options=dynamic, partition_by=["kind"])
    assert rows(spark.table("parts"), "id", "kind") == [(1, "a"), (20, "b"), (30, None), (40, "c")]
    own = spark.table("parts").filter("kind = 'c'").selectExpr("id + 1 AS id", "kind")
    write_table(own, "parts", "overwrite", options=dynamic, partition_by=["kind"])
    assert rows(spark.table("parts"), "id", "kind") == [(1, "a"), (20, "b"), (30, None), (41, "c")]
    write_table(news.limit(0), "parts", "overwrite", options=dynamic, partition_by=["kind"])   # no rows, no partition
    assert spark.table("parts").count() == 4
    assert spark.conf.get(key) == before
    spark.sql("DROP TABLE parts")
