"""Whole flows: sources, CDC with cursors, transforms, dimension or upsert target."""

from pyspark.sql import functions as F

from catalogue import query
from millrace.functions.workspace import shared_folder, stage
from millrace.plans.run import run_flow
from millrace.plans.spec import flow, load_spec
from millrace.sinks.files import write_files
from millrace.sinks.snapshots import SnapshotFolder, part_keys

FIRST, SECOND = "1998-10-03 00:00:00", "2001-08-02 00:00:00"

_STATE_OF_CUSTOMER = """
    -- newest order of each customer in the increment
    CREATE OR REPLACE TEMP VIEW ranked AS
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM temp_table;
    SELECT o_custkey AS customer, UPPER(o_orderpriority) AS priority, o_orderstatus AS status,
           CASE WHEN o_totalprice > 250000 THEN 'bulk' ELSE 'retail' END AS order_size
    FROM ranked WHERE rn = 1;
"""

_VERSIONS = f"""
    WITH facts AS (
        SELECT *, CASE WHEN o_orderdate < TIMESTAMP '{FIRST}' THEN TIMESTAMP '{FIRST}'
                       ELSE TIMESTAMP '{SECOND}' END AS loaded FROM orders),
    states AS (
        SELECT o_custkey AS customer, UPPER(o_orderpriority) AS priority, o_orderstatus AS status,
               CASE WHEN o_totalprice > 250000 THEN 'bulk' ELSE 'retail' END AS order_size, loaded
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, loaded
                                           ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM facts)
        WHERE rn = 1),
    starts AS (
        SELECT * FROM (
            SELECT *, row_number() OVER w = 1 OR priority <> lag(priority) OVER w
                      OR status <> lag(status) OVER w
                      OR order_size <> lag(order_size) OVER w AS opens
            FROM states WINDOW w AS (PARTITION BY customer ORDER BY loaded)) WHERE opens)
    SELECT customer, priority, status, order_size, loaded AS valid_from,
           lead(loaded) OVER w AS valid_to, lead(loaded) OVER w IS NULL AS current_flag,
           CAST(row_number() OVER w AS INTEGER) AS version
    FROM starts WINDOW w AS (PARTITION BY customer ORDER BY loaded)"""

_SCD2 = {"key_columns": ["customer"], "current_flag_column": "current_flag",
         "time_type": "timestamp_ntz"}


def _feeds(t):
    """Two order feeds, each in the two portions in which it arrives."""
    early = F.col("o_orderdate") < F.lit(FIRST).cast("timestamp_ntz")
    open_orders = F.col("o_orderstatus") == "O"
    for portion in (early, ~early):
        yield (t.orders.filter(portion & open_orders), t.orders.filter(portion & ~open_orders))


def _run_twice(t, spec_for):
    """Let both feeds grow, and run the flow after each portion."""
    left, right, sink, state = (shared_folder(t.spark, n) for n in ("feed", "feed", "sink", "state"))
    spec = spec_for(left, right, sink, state)
    for (first, second), moment in zip(_feeds(t), (FIRST, SECOND)):
        write_files(first, left, "parquet")
        write_files(second, right, "parquet")
        result = run_flow(t.spark, spec, as_of=moment)
    return result.frame


def _dimension_flow(**settings):
    def spec(left, right, sink, state):
        cdc = {"enabled": True, "mode": "timestamp", "timestamp": {"column": "o_orderdate"}, "state": state}
        return (flow("customers")
                .source("parquet", path=left, cdc=cdc, name="open")
                .source("parquet", path=right, cdc=cdc, name="other")
                .sql(_STATE_OF_CUSTOMER)
                .target("s3", path=sink, format="parquet", scd2=_SCD2, **settings)
                .spec())

    return spec


@query("etl_flow", _VERSIONS)
def etl_flow(t):
    """Two feeds -> CDC -> union -> SQL -> type 2 dimension, in two runs."""
    return _run_twice(t, _dimension_flow())


@query("etl_flow_small", _VERSIONS)
def etl_flow_small(t):
    """The same with an increment that always counts as small enough to be broadcast."""
    return _run_twice(t, _dimension_flow(broadcast_bytes=1 << 40))


@query("etl_flow_large", _VERSIONS)
def etl_flow_large(t):
    """The same with an increment that never does: another plan, the same rows."""
    return _run_twice(t, _dimension_flow(broadcast_bytes=-1))


@query("etl_flow_self_overwrite", """
    SELECT o_orderkey, o_custkey, o_totalprice * 4 AS o_totalprice FROM orders WHERE o_orderstatus <> 'P'""")
def etl_flow_self_overwrite(t):
    """A plain folder that a flow reads and overwrites, twice."""
    path = shared_folder(t.spark, "sink")
    write_files(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), path, "parquet")
    spec = (flow("again").source("parquet", path=path)
            .sql("SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice, o_orderstatus FROM temp_table "
                 "WHERE o_orderstatus <> 'P'")
            .target("parquet", path=path, mode="overwrite").spec())
    run_flow(t.spark, spec)
    run_flow(t.spark, spec)
    return t.spark.read.parquet(path).drop("o_orderstatus")


@query("etl_flow_chained", """
    SELECT o_custkey, COUNT(*) AS orders, MAX(o_orderkey) AS newest FROM orders GROUP BY o_custkey""")
def etl_flow_chained(t):
    """A flow reads what another one has merged in two loads: current rows, each once."""
    middle, sink = shared_folder(t.spark, "sink"), shared_folder(t.spark, "sink")
    early = F.col("o_orderdate") < F.lit(FIRST).cast("timestamp_ntz")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    for portion in (rows.filter(early), rows):
        feed = shared_folder(t.spark, "feed")
        write_files(portion, feed, "parquet")
        run_flow(t.spark, flow("first").source("parquet", path=feed)
                 .target("parquet", path=middle, mode="merge", merge_keys=["o_orderkey"]).spec())
    second = (flow("second").source("s3", path=middle, format="parquet")
              .sql("SELECT o_custkey, COUNT(*) AS orders, MAX(o_orderkey) AS newest FROM temp_table GROUP BY o_custkey")
              .target("parquet", path=sink, mode="merge", merge_keys=["o_custkey"]).spec())
    return run_flow(t.spark, second).frame


_CONNECTED = """
name: connected
source:
  type: parquet
  connection: lake
  config: {path: "a path that the connection replaces", schema: "c_custkey BIGINT, c_name STRING, c_nationkey INT"}
transformations:
  - {type: python, config: {function: not_null, args: {columns: [c_custkey]}}}
target:
  type: s3
  connection: warehouse
  config: {format: csv, mode: overwrite}
"""


@query("etl_flow_connections", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def etl_flow_connections(t):
    """Named connections of file types; what they set comes before what the section sets."""
    sink = shared_folder(t.spark, "sink")
    connections = {"connections": {
        "parquet": {"lake": {"path": t.path("customer")}},
        "s3": {"warehouse": {"path": sink, "format": "parquet"}}}}
    run_flow(t.spark, load_spec(_CONNECTED, connections))
    return t.spark.read.parquet(sink)


_YAML = """
name: customers_yaml
sources:
  - type: s3
    name: open
    config:
      path: "{left}"
      format: parquet
      cdc: &cdc
        enabled: true
        mode: sequence
        sequence: {{column: o_orderkey}}
        initial: null
        state: "{state}"
  - type: s3
    name: other
    config: {{path: "{right}", format: parquet, cdc: *cdc}}
transformations:
  - type: python
    config: {{function: not_null, args: {{columns: [o_custkey, o_orderdate]}}}}
  - type: sql
    config:
      query: |
        CREATE OR REPLACE TEMP VIEW kept AS
        SELECT o_orderkey, o_custkey, UPPER(o_orderpriority) AS priority, o_totalprice FROM temp_table;
        SELECT * FROM kept;
target:
  type: s3
  config:
    path: "{sink}"
    format: parquet
    mode: merge
    merge_keys: [o_orderkey]
scheduler: cron
schedule_cron: "0 2 * * *"
"""


@query("etl_flow_yaml", """
    WITH orders_by_feed AS (
        SELECT *, o_orderdate < TIMESTAMP '1998-10-03' AS early, o_orderstatus = 'O' AS is_open FROM orders),
    marks AS (SELECT is_open, MAX(o_orderkey) AS mark FROM orders_by_feed WHERE early GROUP BY is_open)
    SELECT o_orderkey, o_custkey, UPPER(o_orderpriority) AS priority, o_totalprice
    FROM orders_by_feed o LEFT JOIN marks m ON m.is_open = o.is_open
    WHERE early OR m.mark IS NULL OR o_orderkey > m.mark""")
def etl_flow_yaml(t):
    """A YAML flow with sequence cursors and an upsert; rows below a cursor count as seen."""
    return _run_twice(t, lambda left, right, sink, state: load_spec(
        _YAML.format(left=left, right=right, sink=sink, state=state)))


@query("etl_flow_change_log", """
    WITH log AS (SELECT o_custkey, o_orderpriority, o_orderstatus, o_orderdate >= TIMESTAMP '1998-10-03' AS late,
                        o_orderkey FROM orders),
    mark AS (SELECT MAX(o_orderkey) AS seen FROM log WHERE NOT late),
    last_entry AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY late DESC, o_orderkey DESC) AS rn
                   FROM log, mark WHERE NOT late OR o_orderkey > seen OR seen IS NULL)
    SELECT o_custkey, o_orderpriority FROM last_entry WHERE rn = 1 AND o_orderstatus <> 'F'""")
def etl_flow_change_log(t):
    """One growing change log with a cursor: the second run takes newer entries only, an old one cannot win."""
    op = (F.when(F.col("o_orderstatus") == "F", "D").when(F.col("o_orderstatus") == "O", "U")
           .otherwise("I"))
    log = t.orders.select("o_custkey", "o_orderpriority", "o_orderdate",
                          F.col("o_orderkey").alias("seq"), op.alias("op"))
    early = F.col("o_orderdate") < F.lit(FIRST).cast("timestamp_ntz")
    sink, feed, state = (shared_folder(t.spark, n) for n in ("sink", "feed", "state"))
    spec = (flow("log").source("parquet", path=feed, cdc={"enabled": True, "mode": "binlog", "state": state,
                                                         "binlog": {"keys": ["o_custkey"]}})
            .target("parquet", path=sink).spec())
    for portion in (early, ~early):
        write_files(log.filter(portion).drop("o_orderdate"), feed, "parquet")
        result = run_flow(t.spark, spec)
    return result.frame


# -- targets laid out by a hash of the key ------------------------------------------------------------

@query("scd2_bucketed", _VERSIONS)
def scd2_bucketed(t):
    """The dimension flow into 16 hash buckets: the second run reads and replaces only those its keys fall into."""
    return _run_twice(t, _dimension_flow(buckets=16))


_NEWEST = """
    SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
        FROM orders) WHERE rn = 1"""


@query("upsert_bucketed", _NEWEST)
def upsert_bucketed(t):
    """Newest order of each customer, upserted into 32 hash buckets in four portions."""
    feed, sink = shared_folder(t.spark, "feed"), shared_folder(t.spark, "sink")
    spec = (flow("newest").source("parquet", path=feed)
            .sql("SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM (SELECT *, row_number() OVER "
                 "(PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM temp_table) WHERE rn = 1")
            .target("parquet", path=sink, mode="merge", merge_keys=["o_custkey"], buckets=32).spec())
    moments = ["1996-01-01", "1997-06-01", "1999-01-01", "2100-01-01"]
    since = None
    for until in moments:
        day = F.col("o_orderdate")
        portion = t.orders.filter(day < F.lit(until).cast("timestamp_ntz"))
        if since:
            portion = portion.filter(day >= F.lit(since).cast("timestamp_ntz"))
        write_files(portion, feed, "parquet", "overwrite")
        result = run_flow(t.spark, spec)
        since = until
    return result.frame


@query("sink_delta_listing", """
    SELECT o_orderkey, o_custkey, CAST(YEAR(o_orderdate) AS INTEGER) AS year FROM orders WHERE MONTH(o_orderdate) <> 2
    UNION ALL SELECT o_orderkey, -o_custkey, CAST(YEAR(o_orderdate) AS INTEGER) FROM orders WHERE MONTH(o_orderdate) = 2
    UNION ALL SELECT o_orderkey, o_custkey, CAST(YEAR(o_orderdate) AS INTEGER) FROM orders WHERE MONTH(o_orderdate) <= 8""")
def sink_delta_listing(t):
    """Twenty commits by year: twelve months and eight again appended, but February replaces what its years hold by then."""
    folder = SnapshotFolder(t.spark, shared_folder(t.spark, "sink"))
    year = F.year("o_orderdate").alias("year")
    rows = t.orders.select("o_orderkey", "o_custkey", year, F.month("o_orderdate").alias("month"))
    for number in range(20):
        month = number % 12 + 1
        mine = rows.filter(F.col("month") == month)
        if number == 1:
            # What is there, and the month with another sign, in place of the partitions of its years.
            touched = part_keys(mine, ["year"])
            new = folder.read(touched).unionByName(mine.select("o_orderkey", (-F.col("o_custkey")).alias("o_custkey"), "year"))
            folder.commit(new, partition_by=["year"], replace=touched)
        else:
            folder.commit(mine.drop("month"), partition_by=["year"], replace=() if number else None)
    return folder.read()


@query("etl_flow_scd2_after_merge", f"""
    WITH newest AS ({_NEWEST})
    SELECT o_custkey AS customer, o_orderpriority AS priority, m.valid_from, m.valid_to, m.current_flag, CAST(m.version AS INTEGER) AS version
    FROM newest, (VALUES (TIMESTAMP '1998-10-03', TIMESTAMP '2001-08-02', FALSE, 1), (TIMESTAMP '2001-08-02', NULL, FALSE, 2))
         AS m(valid_from, valid_to, current_flag, version)
    WHERE o_custkey % 2 = 0 OR version = 1
    UNION ALL
    SELECT o_custkey, 'AGAIN', TIMESTAMP '2003-01-01', NULL, TRUE, CAST(3 AS INTEGER) FROM newest WHERE o_custkey % 2 = 0
    UNION ALL
    SELECT o_custkey, 'AGAIN', TIMESTAMP '2003-01-01', NULL, TRUE, CAST(2 AS INTEGER) FROM newest WHERE o_custkey % 2 = 1""")
def scd2_after_merge(t):
    """Two type 2 loads, a merge of the same layout that closes every open row, and a third load: numbers go on."""
    return _after_merge(t)


def _after_merge(t, **settings):
    feed, sink = shared_folder(t.spark, "feed"), shared_folder(t.spark, "sink")
    newest = t.orders.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("priority"))
    newest = newest.withColumnRenamed("o_custkey", "customer")
    type2 = flow("d").source("parquet", path=feed).target("parquet", path=sink, scd2=_SCD2, **settings).spec()

    def load(rows, moment):
        write_files(rows, feed, "parquet", "overwrite")
        return run_flow(t.spark, type2, as_of=moment).frame

    load(newest, FIRST)
    # Every second customer gets a second version with the same priority in the end.
    even = F.col("customer") % 2 == 0
    load(newest.filter(even).withColumn("priority", F.lit("between")), SECOND)
    # A merge flow that writes the same columns: it closes what is open, and gives the second versions their priority back.
    closing = (flow("close").source("parquet", path=feed)
               .target("parquet", path=sink, mode="merge", merge_keys=["customer", "version"], partition_by=["current_flag"], **settings).spec())
    there = SnapshotFolder(t.spark, sink).read().filter("current_flag").drop("priority").join(newest, "customer")
    closed = there.withColumn("current_flag", F.lit(False)).withColumn(
        "valid_to", F.when(F.col("version") == 1, F.lit(SECOND).cast("timestamp_ntz")))
    write_files(closed, feed, "parquet", "overwrite")
    run_flow(t.spark, closing)
    return load(newest.withColumn("priority", F.lit("AGAIN")), "2003-01-01 00:00:00")


@query("sink_catalog_scd2", _VERSIONS)
def catalog_scd2(t):
    """The dimension flow into a catalog table: the second run appends what it closes and replaces the open partition."""
    where = shared_folder(t.spark, "table")
    name = "millrace_" + where.rsplit("-", 1)[1]

    def spec(left, right, sink, state):
        cdc = {"enabled": True, "mode": "timestamp", "timestamp": {"column": "o_orderdate"}, "state": state}
        return (flow("customers").source("parquet", path=left, cdc=cdc, name="open").source("parquet", path=right, cdc=cdc, name="other")
                .sql(_STATE_OF_CUSTOMER).target("table", table=name, options={"path": where}, scd2=_SCD2).spec())

    rows = _run_twice(t, spec)
    columns = ["customer", "priority", "status", "order_size", "valid_from", "valid_to", "current_flag", "version"]
    out = stage(rows.select(*columns), "dimension").frame
    t.spark.sql(f"DROP TABLE {name}")
    return out
