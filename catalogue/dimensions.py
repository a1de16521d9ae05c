"""Type 2 dimensions.

Customers are described by their newest order. Three loads are made: orders before 1997, from 1997
to 1998, and from 1999 on. The oracle does not merge: it derives all versions at once from the
sequence of states, with window functions.
"""

from pyspark.sql import functions as F

from catalogue import query
from catalogue.merges import _REVIEWED, reviewed
from millrace import Scd2Config, current_rows, latest_per_key, scd2_changes, scd2_init, scd2_merge
from millrace.functions.workspace import shared_folder, stage
from millrace.plans.run import run_flow
from millrace.plans.spec import flow
from millrace.sinks.files import write_files

FIRST, SECOND, THIRD = "1997-01-01 00:00:00", "1999-01-01 00:00:00", "2001-08-02 00:00:00"
CUSTOMER = Scd2Config(keys=("o_custkey",), time_type="timestamp_ntz")


def at(moment):
    return F.lit(moment).cast("timestamp_ntz")


def loads(t, *extra):
    """The three increments: newest order per customer in each period."""
    rows = t.orders.select("o_custkey", F.col("o_orderstatus").alias("status"),
                           F.col("o_orderpriority").alias("priority"), "o_orderdate", "o_orderkey",
                           "o_totalprice")
    when = F.col("o_orderdate")
    periods = (when < at(FIRST), (when >= at(FIRST)) & (when < at(SECOND)), when >= at(SECOND))
    return [latest_per_key(rows.filter(p), "o_custkey", ["o_orderdate", "o_orderkey"])
            .select("o_custkey", "status", "priority", *extra) for p in periods]


def after_two_loads(t):
    first, second, _ = loads(t)
    start = stage(scd2_init(first, CUSTOMER, FIRST), "dimension").frame
    return stage(scd2_merge(start, second, CUSTOMER, SECOND), "dimension").frame


def versions_sql(loads=3, tracked=("status", "priority")):
    """All versions after the first ``loads`` loads."""
    differs = " OR ".join(f"{c} IS DISTINCT FROM lag({c}) OVER w" for c in tracked)
    limit = {1: FIRST, 2: SECOND, 3: THIRD}[loads]
    return f"""
    WITH facts AS (
        SELECT o_custkey, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate, o_orderkey,
               CASE WHEN o_orderdate < TIMESTAMP '{FIRST}' THEN TIMESTAMP '{FIRST}'
                    WHEN o_orderdate < TIMESTAMP '{SECOND}' THEN TIMESTAMP '{SECOND}'
                    ELSE TIMESTAMP '{THIRD}' END AS loaded
        FROM orders WHERE o_orderdate < TIMESTAMP '{limit}'),
    states AS (
        SELECT o_custkey, status, priority, loaded FROM (
            SELECT *, row_number() OVER (PARTITION BY o_custkey, loaded
                                         ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM facts)
        WHERE rn = 1),
    starts AS (
        SELECT o_custkey, status, priority, loaded FROM (
            SELECT *, row_number() OVER w = 1 OR {differs} AS opens
            FROM states WINDOW w AS (PARTITION BY o_custkey ORDER BY loaded)) WHERE opens),
    versions AS (
        SELECT o_custkey, status, priority, loaded AS valid_from, lead(loaded) OVER w AS valid_to,
               lead(loaded) OVER w IS NULL AS is_current, CAST(row_number() OVER w AS INTEGER) AS version
        FROM starts WINDOW w AS (PARTITION BY o_custkey ORDER BY loaded))"""


@query("scd2_initial", f"{versions_sql(1)} SELECT * FROM versions")
def scd2_initial(t):
    return scd2_init(loads(t)[0], CUSTOMER, FIRST)


@query("scd2_merge", f"{versions_sql()} SELECT * FROM versions")
def merged(t):
    return scd2_merge(after_two_loads(t), loads(t)[2], CUSTOMER, THIRD)


@query("scd2_merge_measured_source", f"{versions_sql()} SELECT * FROM versions")
def merged_measured(t):
    """The source is staged, and broadcast only if its measured size allows it."""
    source = stage(loads(t)[2])
    return scd2_merge(after_two_loads(t), source.frame, CUSTOMER, THIRD, broadcast_source=source.small)


@query("scd2_unchanged", f"{versions_sql(2)} SELECT * FROM versions")
def scd2_unchanged(t):
    """Loading what is already there changes nothing."""
    dimension = after_two_loads(t)
    again = current_rows(dimension, CUSTOMER).select("o_custkey", "status", "priority")
    return scd2_merge(dimension, again, CUSTOMER, THIRD)


@query("scd2_current", f"{versions_sql()} SELECT * FROM versions WHERE is_current")
def scd2_current(t):
    return current_rows(merged(t), CUSTOMER)


@query("scd2_changes", f"""{versions_sql()}
    SELECT * FROM versions WHERE valid_from = TIMESTAMP '{THIRD}' OR valid_to = TIMESTAMP '{THIRD}'""")
def changes(t):
    return scd2_changes(after_two_loads(t), loads(t)[2], CUSTOMER, THIRD)


@query("scd2_tracked_columns", f"{versions_sql(tracked=('status',))} SELECT * FROM versions")
def tracked(t):
    """Only a new status opens a version; the priority comes along with it."""
    config = Scd2Config(keys=("o_custkey",), track=("status",), time_type="timestamp_ntz")
    first, second, third = loads(t)
    start = stage(scd2_init(first, config, FIRST), "dimension").frame
    middle = stage(scd2_merge(start, second, config, SECOND), "dimension").frame
    return scd2_merge(middle, third, config, THIRD)


@query("scd2_extra_columns", f"""{versions_sql()}
    SELECT v.*, s.loaded AS first_seen FROM versions v LEFT JOIN (
        SELECT o_custkey, MIN(loaded) AS loaded FROM facts GROUP BY o_custkey
        HAVING MIN(loaded) <= TIMESTAMP '{SECOND}') s USING (o_custkey)""")
def extra_columns(t):
    """A column only the source has is dropped; one only the target has is carried along."""
    born = after_two_loads(t).groupBy("o_custkey").agg(F.min("valid_from").alias("first_seen"))
    dimension = after_two_loads(t).join(born, "o_custkey")
    return scd2_merge(dimension, loads(t, "o_totalprice")[2], CUSTOMER, THIRD)


_PAIR = Scd2Config(keys=("l_partkey", "l_suppkey"), time_type="timestamp_ntz", valid_from="starts",
                   valid_to="ends", is_current="active", version="nr",
                   order_by=["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])


@query("scd2_composite_key", f"""
    WITH facts AS (
        SELECT *, CASE WHEN l_shipdate < TIMESTAMP '{SECOND}' THEN TIMESTAMP '{SECOND}'
                       ELSE TIMESTAMP '{THIRD}' END AS loaded FROM lineitem),
    states AS (
        SELECT l_partkey, l_suppkey, l_returnflag, l_quantity, loaded FROM (
            SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey, loaded
                ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC,
                         l_extendedprice DESC) AS rn FROM facts) WHERE rn = 1),
    starts AS (
        SELECT * FROM (
            SELECT *, row_number() OVER w = 1 OR l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER w
                      OR l_quantity IS DISTINCT FROM lag(l_quantity) OVER w AS opens
            FROM states WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY loaded)) WHERE opens)
    SELECT l_partkey, l_suppkey, l_returnflag, l_quantity, loaded AS starts, lead(loaded) OVER w AS ends,
           lead(loaded) OVER w IS NULL AS active, CAST(row_number() OVER w AS INTEGER) AS nr
    FROM starts WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY loaded)""")
def composite_key(t):
    """Keys repeat in the source; the newest shipment of each pair counts."""
    rows = t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_shipdate",
                             "l_orderkey", "l_linenumber", "l_extendedprice")
    first = rows.filter(F.col("l_shipdate") < at(SECOND))
    start = scd2_init(first, _PAIR, SECOND).drop("l_shipdate", "l_orderkey", "l_linenumber",
                                                 "l_extendedprice")
    return scd2_merge(stage(start, "dimension").frame, rows.filter(F.col("l_shipdate") >= at(SECOND)),
                      _PAIR, THIRD)


@query("scd2_null_keys", f"""
    WITH {_REVIEWED}, moments AS (
        SELECT TIMESTAMP '{FIRST}' AS t1, TIMESTAMP '{SECOND}' AS t2)
    SELECT d.k, d.kind, d.id, t1 AS valid_from, CASE WHEN w.k IS NOT NULL THEN t2 END AS valid_to,
           w.k IS NULL AS is_current, CAST(1 AS INTEGER) AS version
    FROM docs d LEFT JOIN web w ON d.k = w.k CROSS JOIN moments
    UNION ALL
    SELECT w.k, w.kind, w.id, t2, NULL, TRUE,
           CAST(CASE WHEN d.k IS NOT NULL THEN 2 ELSE 1 END AS INTEGER)
    FROM web w LEFT JOIN docs d ON d.k = w.k CROSS JOIN moments""")
def null_keys(t):
    """A key that is NULL matches nothing: its old rows stay, its new rows are added."""
    config = Scd2Config(keys=("k",), time_type="timestamp_ntz")
    docs, web = reviewed(t)
    return scd2_merge(scd2_init(docs, config, FIRST), web, config, SECOND)


def _all_loads(t):
    """Six increments: the newest order of each customer in each period."""
    moments = ["1995-01-01", "1996-01-01", "1997-01-01", "1998-01-01", "1999-01-01", "2001-08-02"]
    rows = t.orders.select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_orderdate", "o_orderkey")
    since = None
    for until in moments:
        portion = rows.filter(F.col("o_orderdate") < at(until))
        if since:
            portion = portion.filter(F.col("o_orderdate") >= at(since))
        yield latest_per_key(portion, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "status", "priority"), until
        since = until


_BY_YEAR = """
    facts AS (
        SELECT o_custkey, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate, o_orderkey,
               CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN TIMESTAMP '1995-01-01' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN TIMESTAMP '1996-01-01'
                    WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN TIMESTAMP '1997-01-01' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN TIMESTAMP '1998-01-01'
                    WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN TIMESTAMP '1999-01-01' ELSE TIMESTAMP '2001-08-02' END AS loaded
        FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-02'),
    states AS (
        SELECT o_custkey, status, priority, loaded FROM (
            SELECT *, row_number() OVER (PARTITION BY o_custkey, loaded ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM facts) WHERE rn = 1)"""


@query("scd2_backdated", f"""
    WITH {_BY_YEAR},
    marked AS (
        SELECT *, row_number() OVER w = 1 OR status <> lag(status) OVER w OR priority <> lag(priority) OVER w AS opens
        FROM states WINDOW w AS (PARTITION BY o_custkey ORDER BY loaded))
    SELECT o_custkey, status, priority, loaded AS valid_from, lead(loaded) OVER w AS valid_to, lead(loaded) OVER w IS NULL AS is_current,
           CAST(row_number() OVER w AS INTEGER) AS version
    FROM marked WHERE opens WINDOW w AS (PARTITION BY o_custkey ORDER BY loaded)""")
def scd2_backdated_loads(t):
    """Six loads in shuffled order into hash buckets; the oracle sees them in the order of their dates."""
    feed, sink = shared_folder(t.spark, "feed"), shared_folder(t.spark, "sink")
    scd2 = {"key_columns": ["o_custkey"], "time_type": "timestamp_ntz", "backdated": True}
    spec = flow("late").source("parquet", path=feed).target("parquet", path=sink, scd2=scd2, buckets=8).spec()
    loads_by_date = list(_all_loads(t))
    for n in (3, 0, 5, 1, 4, 2):
        rows, moment = loads_by_date[n]
        write_files(rows, feed, "parquet", "overwrite")
        result = run_flow(t.spark, spec, as_of=moment)
    return result.frame.drop("confirmed_at")


_SNAPSHOTS = f"""
    WITH {_BY_YEAR},
    days(loaded) AS (SELECT DISTINCT loaded FROM facts),
    seen AS (
        SELECT c.o_custkey, d.loaded, s.status, s.priority, s.o_custkey IS NOT NULL AS there
        FROM (SELECT DISTINCT o_custkey FROM facts) c CROSS JOIN days d LEFT JOIN states s ON s.o_custkey = c.o_custkey AND s.loaded = d.loaded),
    marked AS (
        SELECT *, coalesce(there <> lag(there) OVER w, there) OR (there AND (status <> lag(status) OVER w OR priority <> lag(priority) OVER w)) AS turns
        FROM seen WINDOW w AS (PARTITION BY o_custkey ORDER BY loaded)),
    turns AS (SELECT *, lead(loaded) OVER (PARTITION BY o_custkey ORDER BY loaded) AS ends FROM marked WHERE turns)
    SELECT o_custkey, status, priority, loaded AS valid_from, ends AS valid_to, ends IS NULL AS is_current,
           CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY loaded) AS INTEGER) AS version
    FROM turns WHERE there"""


def _snapshot_loads(t, **settings):
    feed, sink = shared_folder(t.spark, "feed"), shared_folder(t.spark, "sink")
    scd2 = {"key_columns": ["o_custkey"], "time_type": "timestamp_ntz", "deletes": "close"}
    spec = flow("full").source("parquet", path=feed).target("parquet", path=sink, scd2=scd2, **settings).spec()
    for rows, moment in _all_loads(t):
        write_files(rows, feed, "parquet", "overwrite")
        result = run_flow(t.spark, spec, as_of=moment)
    return result.frame


@query("scd2_snapshot_deletes", _SNAPSHOTS)
def snapshot_deletes(t):
    """Each period's customers as a full snapshot: who orders nothing is closed, and opened again later with the next number."""
    return _snapshot_loads(t)


@query("scd2_snapshot_deletes_small", _SNAPSHOTS)
def snapshot_deletes_small(t):
    """The same with sources that always count as small enough to be broadcast, in buckets."""
    return _snapshot_loads(t, broadcast_bytes=1 << 40, buckets=4)


@query("scd2_snapshot_deletes_large", _SNAPSHOTS)
def snapshot_deletes_large(t):
    """The same with sources that never do."""
    return _snapshot_loads(t, broadcast_bytes=-1)
