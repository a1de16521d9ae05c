"""Event-time windows over arriving files, and user-defined aggregates and table functions."""

from pyspark.sql import functions as F

from catalogue import query
from millrace.functions.aggregates import (Runs, aggregate, call_table_function, register_aggregate, register_table_function,
                                          weighted_quantile)
from millrace.functions.transforms import sql_block
from millrace.functions.workspace import shared_folder
from millrace.sinks.files import write_files
from millrace.streaming.windows import Windows, stream_windows

# The days at which the events' files are cut.
_CUTS = ["2024-01-08", "2024-01-15 12:00:00", "2024-01-22", "2100-01-01"]
_SUMS = {"rows": "count(*)", "cents": "sum(cast(round(value * 100) as bigint))"}


def _arriving(t, windows, keys, delay):
    """Four files of events arrive one after the other; after each the stream runs until it has taken all in."""
    feed, target, checkpoint = (shared_folder(t.spark, n) for n in ("feed", "windows", "checkpoint"))
    since = None
    for until in _CUTS:
        portion = t.events.filter(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
        if since:
            portion = portion.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
        write_files(portion, feed, "parquet", "append")
        run = stream_windows(t.spark, feed, t.events.schema, "ts", windows, _SUMS, target=target, checkpoint=checkpoint, keys=keys, delay=delay)
        since = until
    return run.frame


@query("stream_tumbling", """
    WITH mark AS (SELECT max(ts) - INTERVAL 3 HOUR AS mark FROM events)
    SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end,
           count(*) AS rows, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM events, mark WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= mark GROUP BY 1, 2, 3""")
def stream_tumbling(t):
    """Events by type in windows of six hours; those that the watermark, three hours behind, has closed."""
    return _arriving(t, Windows(size="6 hours"), "event_type", "3 hours")


@query("stream_sliding", """
    WITH mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events),
    placed AS (SELECT value, time_bucket(INTERVAL 8 HOUR, ts) - to_hours(8 * back) AS window_start FROM events, (VALUES (0), (1), (2)) AS b(back))
    SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*) AS rows, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM placed, mark WHERE window_start + INTERVAL 24 HOUR <= mark GROUP BY window_start""")
def stream_sliding(t):
    """All events in windows of a day that begin every eight hours."""
    return _arriving(t, Windows(size="24 hours", slide="8 hours"), (), "1 hour")


@query("stream_session", """
    WITH mark AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM events),
    starts AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 5 HOUR, TRUE) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM starts)
    SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 5 HOUR AS window_end, count(*) AS rows,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM numbered, mark GROUP BY user_id, n, mark HAVING max(ts) + INTERVAL 5 HOUR <= mark""")
def stream_session(t):
    """Sessions of users: a pause of five hours ends one."""
    return _arriving(t, Windows(gap="5 hours"), "user_id", "2 hours")


_WEIGHED = """
    WITH w AS (SELECT l_returnflag, l_quantity, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2),
    c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS upto, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM w)
    SELECT l_returnflag, min(l_quantity) AS value FROM c WHERE upto >= 0.5 * total GROUP BY l_returnflag"""


@query("udaf_weighted_quantile", _WEIGHED)
def udaf_weighted_quantile(t):
    """Quantity at half of the weight, for three keys that hold all order lines: tasks send states, not rows."""
    register_aggregate("weighted_median", weighted_quantile(0.5))
    return aggregate(t.lineitem, "weighted_median", "l_returnflag", ["l_quantity", "l_linenumber"])


_RUNS = """
    WITH marked AS (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island
        FROM events)
    SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value, min(ts) AS first_at, max(ts) AS last_at, count(*) AS length
    FROM marked GROUP BY user_id, event_type, island"""


@query("udtf_runs", _RUNS)
def udtf_runs(t):
    """Runs of equal event types of each user, by a table function called from a SQL block."""
    register_table_function(t.spark, "runs", Runs, "key STRING, value STRING, first_at TIMESTAMP_NTZ, last_at TIMESTAMP_NTZ, length BIGINT")
    rows = t.events.select(F.col("user_id").cast("string").alias("who"), "event_type", "ts", "event_id")
    return sql_block(rows, "SELECT * FROM runs(TABLE(temp_table) PARTITION BY who ORDER BY (ts, event_id))")


@query("udtf_runs_step", _RUNS)
def udtf_runs_step(t):
    """The same as a named step."""
    rows = t.events.select(F.col("user_id").cast("string").alias("who"), "event_type", "ts", "event_id")
    return call_table_function(rows, "runs", "who", ["ts", "event_id"])
