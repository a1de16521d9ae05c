"""Scans and sinks (files, staged folders, catalog tables)."""

from pyspark.sql import functions as F

from catalogue import query
from millrace import SnapshotFolder, latest_per_key, staged_overwrite
from millrace.functions.workspace import shared_folder, stage
from millrace.operators.merge import upsert
from millrace.plans.run import run_flow
from millrace.plans.spec import flow
from millrace.sinks.files import write_files, write_table
from millrace.sinks.snapshots import part_keys
from millrace.sources import read_source, read_target
from millrace.sources.files import read_files

_ACCOUNTS = """
    SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer"""


def _accounts(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                             F.col("c_acctbal").alias("balance"))


def _vendors(t):
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                             F.col("s_acctbal").alias("balance"))


@query("scan_parquet_project_filter", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice
    FROM lineitem WHERE l_quantity > 45""")
def scan_parquet(t):
    rows = read_source(t.spark, "s3", {"path": t.path("lineitem"), "format": "parquet"})
    return (rows.filter(F.col("l_quantity") > 45)
                .select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))


@query("scan_csv_header", "SELECT * FROM customer")
def scan_csv_header(t):
    path = shared_folder(t.spark, "csv")
    write_files(t.customer, path, "csv", "append", {"header": "true"})
    return read_source(t.spark, "csv", {
        "path": path, "options": {"header": "true"},
        "schema": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                  "c_mktsegment STRING"})


@query("scan_csv_infer", """
    SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_brand, p_size, p_retailprice FROM part""")
def scan_csv_infer(t):
    path = shared_folder(t.spark, "csv")
    options = {"header": "true", "inferSchema": "true"}
    rows = t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice")
    write_files(rows, path, "csv", "append", {"header": "true"})
    return read_files(t.spark, path, "csv", options)


@query("scan_csv_plain", """
    SELECT CAST(s_suppkey AS VARCHAR) AS _c0, s_name AS _c1, CAST(s_nationkey AS VARCHAR) AS _c2
    FROM supplier""")
def scan_csv_plain(t):
    path = shared_folder(t.spark, "csv")
    write_files(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), path, "csv")
    return read_source(t.spark, "s3", {"path": path, "format": "csv"})


@query("sink_parquet_append", "SELECT * FROM orders UNION ALL SELECT * FROM orders")
def sink_append(t):
    path = shared_folder(t.spark, "sink")
    for _ in range(2):
        write_files(t.orders, path, "parquet", "append")
    return read_files(t.spark, path, "parquet")


@query("sink_parquet_overwrite", """
    SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier""")
def sink_overwrite(t):
    path = shared_folder(t.spark, "sink")
    write_files(_accounts(t), path, "parquet", "overwrite")
    write_files(_vendors(t), path, "parquet", "overwrite")
    return read_files(t.spark, path, "parquet")


@query("sink_mode_ignore", _ACCOUNTS)
def sink_ignore(t):
    path = shared_folder(t.spark, "sink")
    write_files(_accounts(t), path, "parquet", "ignore")
    write_files(_vendors(t), path, "parquet", "ignore")
    return read_files(t.spark, path, "parquet")


@query("sink_parquet_partitioned", """
    SELECT o_orderkey, o_totalprice, o_orderdate, o_orderstatus FROM orders""")
def sink_partitioned(t):
    path = shared_folder(t.spark, "sink")
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    write_files(rows, path, "parquet", "overwrite", partition_by=["o_orderstatus"])
    return read_files(t.spark, path, "parquet")


@query("sink_staged_self_overwrite", """
    SELECT s_suppkey AS id, s_name AS name, s_acctbal + 100 AS balance FROM supplier""")
def sink_self_overwrite(t):
    path = shared_folder(t.spark, "sink")
    before = staged_overwrite(t.spark, path, _vendors(t))
    return staged_overwrite(t.spark, path, before.withColumn("balance", F.col("balance") + 100))


@query("sink_staged_touched_partitions", """
    WITH news AS (
        SELECT l_returnflag, l_orderkey, MAX(l_linenumber) AS lines
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_returnflag, l_orderkey)
    SELECT l_returnflag, l_orderkey, CAST(0 AS INTEGER) AS lines
    FROM (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem) old
    WHERE l_returnflag <> 'R'
    UNION ALL SELECT l_returnflag, l_orderkey, lines FROM news""")
def sink_touched_partitions(t):
    """Only the partition the increment reaches is read and rewritten; the others are kept by name."""
    keys = ["l_returnflag", "l_orderkey"]
    folder = SnapshotFolder(t.spark, shared_folder(t.spark, "sink"))
    first = t.lineitem.select(*keys).distinct().withColumn("lines", F.lit(0))
    folder.commit(first, partition_by=["l_returnflag"])
    news = stage(t.lineitem.filter(F.col("l_returnflag") == "R")
                 .groupBy(*keys).agg(F.max("l_linenumber").alias("lines"))).frame
    touched = part_keys(news, ["l_returnflag"])
    folder.commit(upsert(folder.read(touched), news, keys), partition_by=["l_returnflag"],
                  replace=touched)
    return folder.read()


@query("sink_catalog_table", """
    SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier""")
def sink_table(t):
    """Append to a catalog table, matching columns by name whatever their order."""
    where = shared_folder(t.spark, "table")
    name = "millrace_" + where.rsplit("-", 1)[1]
    options = {"path": where}
    write_table(_accounts(t), name, "overwrite", options=options)
    write_table(_vendors(t).select("balance", "name", "id"), name, "append", options=options)
    rows = read_target(t.spark, "table", {"table": name})
    t.spark.sql(f"DROP TABLE {name}")       # external: the rows stay
    return rows


def _new_table(t):
    return "millrace_" + shared_folder(t.spark, "table").rsplit("-", 1)[1]


def _kept(t, name):
    """The rows of a table, which is dropped."""
    rows = stage(t.spark.table(name), "rows").frame
    t.spark.sql(f"DROP TABLE {name}")
    return rows


@query("sink_catalog_partitions", """
    SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS price FROM orders
    WHERE o_orderstatus <> 'F'
    UNION ALL SELECT o_orderkey, 'F', CAST(o_totalprice AS DOUBLE) + 1 FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT -p_partkey, 'N', CAST(p_retailprice AS DOUBLE) FROM part""")
def sink_table_partitions(t):
    """A flow overwrites the partitions of a catalog table that its rows fall into: one changed, one new, the others kept."""
    name, feed = _new_table(t), shared_folder(t.spark, "feed")
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
                             F.col("o_totalprice").cast("double").alias("price"))
    write_table(orders, name, "overwrite", partition_by=["status"])
    fresh = t.part.select((-F.col("p_partkey")).alias("id"), F.lit("N").alias("status"), F.col("p_retailprice").cast("double").alias("price"))
    write_files(orders.filter("status = 'F'").withColumn("price", F.col("price") + 1).unionByName(fresh), feed, "parquet")
    run_flow(t.spark, flow("partitions").source("parquet", path=feed)
             .target("table", table=name, mode="overwrite", partition_by=["status"], options={"partitionOverwriteMode": "dynamic"}).spec())
    return _kept(t, name)


@query("sink_catalog_self_overwrite", """
    SELECT c_custkey AS id, c_name AS name, c_acctbal * 2 AS balance FROM customer WHERE c_acctbal > 0""")
def sink_table_self_overwrite(t):
    """A flow reads a catalog table and overwrites it."""
    name = _new_table(t)
    write_table(_accounts(t), name, "overwrite")
    run_flow(t.spark, flow("twice").source("table", table=name)
             .sql("SELECT id, name, balance * 2 AS balance FROM temp_table WHERE balance > 0")
             .target("table", table=name, mode="overwrite").spec())
    return _kept(t, name)


@query("sink_catalog_merge_external", """
    SELECT c_custkey AS id, c_name AS name, c_acctbal + 1 AS balance FROM customer
    UNION ALL SELECT -1 - s_suppkey, s_name, s_acctbal FROM supplier""")
def sink_merge_external(t):
    """Two merges into a catalog table whose files lie at a path of the user's."""
    where, feed = shared_folder(t.spark, "table"), shared_folder(t.spark, "feed")
    name = "millrace_" + where.rsplit("-", 1)[1]
    for rows in (_accounts(t), _accounts(t).withColumn("balance", F.col("balance") + 1)
                 .unionByName(_vendors(t).withColumn("id", -1 - F.col("id")))):
        write_files(rows, feed, "parquet", "overwrite")
        run_flow(t.spark, flow("merge").source("parquet", path=feed)
                 .target("table", table=name, options={"path": where}, mode="merge", merge_keys=["id"]).spec())
    rows = read_target(t.spark, "table", {"table": name})
    t.spark.sql(f"DROP TABLE {name}")       # external: the rows stay
    return rows


@query("read_target_csv_options", """
    SELECT o_orderkey, o_orderpriority FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)
            AS rn FROM orders) WHERE rn = 1""")
def read_back_csv(t):
    """A CSV target is read back with the options it was written with."""
    config = {"path": shared_folder(t.spark, "sink"), "format": "csv", "options": {"header": "true"},
              "schema": "o_orderkey BIGINT, o_orderpriority STRING"}
    if read_target(t.spark, "s3", config) is not None:
        raise AssertionError("the target cannot exist yet")
    rows = latest_per_key(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"])
    write_files(rows.select("o_orderkey", "o_orderpriority"), config["path"], "csv",
                options=config["options"])
    return read_target(t.spark, "s3", config)
