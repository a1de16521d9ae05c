"""Change data capture: increments, cursors, stacked sources, change logs."""

from datetime import datetime

from pyspark.sql import functions as F

from catalogue import query
from millrace import (CdcConfig, apply_cdc, apply_change_log, high_water_mark, latest_per_key,
                      net_changes, since_sequence, since_timestamp)
from millrace.functions.workspace import shared_folder, stage
from millrace.operators.cdc import CursorStore
from millrace.plans.run import run_flow
from millrace.plans.spec import flow
from millrace.sinks.files import write_files

CUTOFF = datetime(1998, 10, 3)
MONTH_HALF = datetime(2024, 1, 15)


def _timestamped(**settings):
    return CdcConfig.from_mapping({"enabled": True, "mode": "timestamp",
                                   "timestamp": {"column": "o_orderdate"}, **settings})


@query("cdc_timestamp", "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-10-03'")
def cdc_timestamp(t):
    return apply_cdc(t.orders, _timestamped(), last=CUTOFF)


@query("cdc_timestamp_exclusive", "SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1998-10-03'")
def cdc_timestamp_exclusive(t):
    return apply_cdc(t.orders, _timestamped(inclusive=False), last=CUTOFF)


@query("cdc_timestamp_lookback", """
    SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-14 22:00:00'""")
def cdc_timestamp_lookback(t):
    return since_timestamp(t.events, "ts", MONTH_HALF, lookback="2 hours").select("event_id", "ts")


def _orders_with_visit(t):
    """Orders with the time of a web event; many have none."""
    events = t.events.select(F.col("event_id").alias("o_orderkey"), F.col("ts").alias("updated_at"))
    return t.orders.select("o_orderkey", "o_totalprice").join(events, "o_orderkey", "left")


@query("cdc_timestamp_default", """
    SELECT o_orderkey, o_totalprice, ts AS updated_at
    FROM orders JOIN events ON o_orderkey = event_id WHERE ts IS NOT NULL""")
def cdc_timestamp_default(t):
    """Without a column, a mode or a state: column updated_at, everything there is, no NULLs."""
    return apply_cdc(_orders_with_visit(t), CdcConfig.from_mapping({"enabled": True}))


@query("cdc_nulls_kept", """
    SELECT o_orderkey, o_totalprice, ts AS updated_at
    FROM orders LEFT JOIN events ON o_orderkey = event_id
    WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-15'""")
def cdc_nulls_kept(t):
    return since_timestamp(_orders_with_visit(t), last=MONTH_HALF, nulls="keep")


@query("cdc_sequence", """
    SELECT * FROM events
    WHERE event_id > (SELECT MAX(event_id) FROM events WHERE ts < TIMESTAMP '2024-01-15')""")
def cdc_sequence(t):
    last = high_water_mark(t.events.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")),
                           "event_id").first()[0]
    return since_sequence(t.events, "event_id", last)


@query("cdc_sequence_zero", "SELECT * FROM events WHERE event_id > 0")
def cdc_sequence_zero(t):
    """A start that the specification states: numbers above 0 only."""
    config = CdcConfig.from_mapping({"enabled": True, "mode": "sequence", "initial": 0,
                                     "sequence": {"column": "event_id"}})
    return apply_cdc(t.events, config)


def _first_load(t, rows, column, mode):
    """``rows`` through a flow that has never run."""
    feed, sink, state = (shared_folder(t.spark, n) for n in ("feed", "sink", "state"))
    write_files(rows, feed, "parquet")
    cdc = {"enabled": True, "mode": mode, mode: {"column": column}, "inclusive": False, "state": state}
    run_flow(t.spark, flow("first").source("parquet", path=feed, cdc=cdc).target("parquet", path=sink).spec())
    return t.spark.read.parquet(sink)


@query("cdc_first_load_timestamp", """
    SELECT o_orderkey, o_orderdate - INTERVAL '40' YEAR AS placed FROM orders""")
def cdc_first_load_timestamp(t):
    """Nothing stored means everything, also what is dated long before 1970."""
    rows = t.orders.select("o_orderkey", (F.col("o_orderdate") - F.expr("INTERVAL '40' YEAR")).alias("placed"))
    return _first_load(t, rows, "placed", "timestamp")


@query("cdc_first_load_sequence", """
    SELECT CAST(event_id - 5000 AS BIGINT) AS number, event_type FROM events""")
def cdc_first_load_sequence(t):
    """Numbers of zero and below are loaded like any others."""
    return _first_load(t, t.events.select((F.col("event_id") - 5000).alias("number"), "event_type"), "number", "sequence")


@query("cdc_sequence_first_run", "SELECT * FROM events")
def cdc_sequence_first_run(t):
    return since_sequence(t.events, "event_id")


@query("cdc_disabled", "SELECT * FROM events")
def cdc_disabled(t):
    return apply_cdc(t.events, CdcConfig.from_mapping({"mode": "sequence"}))


@query("cdc_high_water_mark", """
    SELECT event_type, MAX(ts) AS high_water_mark FROM events GROUP BY event_type""")
def cdc_high_water_mark(t):
    return high_water_mark(t.events, "ts", by=["event_type"])


@query("cdc_two_runs", "SELECT * FROM events")
def cdc_two_runs(t):
    """A source that grows between two runs; the stored cursor makes each row arrive once."""
    feed, sink, state = (shared_folder(t.spark, n) for n in ("feed", "sink", "state"))
    spec = (flow("two_runs")
            .source("parquet", path=feed, cdc={"enabled": True, "mode": "timestamp", "inclusive": False,
                                               "timestamp": {"column": "ts"}, "state": state})
            .target("parquet", path=sink).spec())
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    for part in (t.events.filter(F.col("ts") < half), t.events.filter(F.col("ts") >= half)):
        write_files(part, feed, "parquet")
        run_flow(t.spark, spec)
    return t.spark.read.parquet(sink)


@query("cdc_cursor_store", """
    SELECT 'events/' || event_type AS flow, 'event_id' AS cursor_column, 'sequence' AS cursor_type,
           CAST(MAX(event_id) AS VARCHAR) AS cursor_value
    FROM events GROUP BY event_type""")
def cdc_cursor_store(t):
    """One cursor per event type, moved twice; the newest counts."""
    store = CursorStore(t.spark, shared_folder(t.spark, "state"))
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    for n, rows in enumerate((t.events.filter(F.col("ts") < half), t.events)):
        marks = high_water_mark(rows, "event_id", by=["event_type"])
        store.put([(f"events/{kind}", "event_id", "sequence", mark)
                   for kind, mark in marks.collect()], f"run{n}")      # one row per event type
    return latest_per_key(store.rows(), ["flow", "cursor_column"], ["recorded_at", "run_id"]).select(
        "flow", "cursor_column", "cursor_type", "cursor_value")


# -- stacked sources -------------------------------------------------------------------------

@query("union_increments", """
    SELECT o_orderkey AS id, o_orderdate AS ts, o_totalprice AS amount FROM orders
    WHERE o_orderdate >= TIMESTAMP '1998-10-03'
    UNION ALL SELECT l_orderkey, l_shipdate, l_extendedprice FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1999-01-01'""")
def union_increments(t):
    """Two tables, each with its own cursor, stacked by position as their names differ."""
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"),
                             F.col("o_totalprice").alias("amount"))
    lines = t.lineitem.select("l_orderkey", "l_shipdate", "l_extendedprice")
    return since_timestamp(orders, "ts", CUTOFF).union(
        since_timestamp(lines, "l_shipdate", "1999-01-01 00:00:00"))


# -- change log ------------------------------------------------------------------------------
# The last order of a customer before the cutoff is the table; later orders are its change log.
# A finished order (F) deletes the customer's row, an open one (O) updates, the rest (P) insert.

_LAST_BEFORE = """
    old AS (SELECT o_custkey, o_orderpriority, o_totalprice FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
        FROM orders WHERE o_orderdate < TIMESTAMP '1998-10-03') WHERE rn = 1)"""

_LOG_END = """
    last_entry AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn
        FROM orders WHERE o_orderdate >= TIMESTAMP '1998-10-03') WHERE rn = 1)"""


def last_before(t):
    before = t.orders.filter(F.col("o_orderdate") < F.lit("1998-10-03").cast("timestamp_ntz"))
    return latest_per_key(before, "o_custkey", ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderpriority", "o_totalprice")


def change_log(t):
    op = (F.when(F.col("o_orderstatus") == "F", "D").when(F.col("o_orderstatus") == "O", "U")
           .otherwise("I"))
    return since_timestamp(t.orders, "o_orderdate", CUTOFF).select(
        "o_custkey", "o_orderpriority", "o_totalprice", F.col("o_orderkey").alias("seq"), op.alias("op"))


@query("cdc_change_log", f"""
    WITH {_LAST_BEFORE}, {_LOG_END}
    SELECT * FROM old WHERE o_custkey NOT IN (SELECT o_custkey FROM last_entry)
    UNION ALL SELECT o_custkey, o_orderpriority, o_totalprice FROM last_entry WHERE o_orderstatus <> 'F'""")
def cdc_change_log(t):
    log = stage(change_log(t), "log")
    return apply_change_log(last_before(t), log.frame, "o_custkey", broadcast_log=log.small)


@query("cdc_net_changes", f"""
    WITH {_LOG_END}
    SELECT o_custkey, o_orderkey AS seq,
           CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'U' ELSE 'I' END AS op FROM last_entry""")
def cdc_net_changes(t):
    return net_changes(change_log(t), "o_custkey").select("o_custkey", "seq", "op")
