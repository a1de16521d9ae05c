"""Joins on nearness: as-of, interval and band."""

from pyspark.sql import functions as F

from catalogue import query
from millrace import asof_join, band_join, interval_join


def _clicks_and_views(t):
    clicks = t.events.filter("event_type = 'click'").select("event_id", "user_id", "ts", "value")
    views = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("view_id"))
    return clicks, views


@query("join_asof", """
    WITH clicks AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click'),
         views AS (SELECT user_id, ts AS seen_at, event_id AS view_id FROM events WHERE event_type = 'view')
    SELECT c.event_id, c.user_id, c.ts, c.value, v.seen_at, coalesce(v.view_id, -1) AS view_id
    FROM clicks c ASOF LEFT JOIN views v ON c.user_id = v.user_id AND c.ts >= v.seen_at""")
def join_asof(t):
    """Every click with its user's latest view before it."""
    clicks, views = _clicks_and_views(t)
    return asof_join(clicks, views, "user_id", "ts", "seen_at").withColumn("view_id", F.coalesce("view_id", F.lit(-1)))


@query("join_asof_orders", """
    WITH e AS (SELECT event_id, user_id AS o_custkey, ts - INTERVAL 27 YEAR AS at FROM events),
         o AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (
               SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)
    SELECT e.event_id, e.o_custkey, e.at, o.o_orderdate, o.o_orderkey, o.o_totalprice
    FROM e ASOF JOIN o ON e.o_custkey = o.o_custkey AND e.at >= o.o_orderdate""")
def join_asof_orders(t):
    """Events, set back into the years of the orders, with the customer's latest order; of several of one day the one with the largest number."""
    events = t.events.select("event_id", F.col("user_id").alias("o_custkey"), (F.col("ts") - F.expr("INTERVAL 27 YEAR")).alias("at"))
    orders = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return asof_join(events, orders, "o_custkey", "at", "o_orderdate", how="inner", order_by="o_orderkey")


@query("join_asof_hot_key", """
    WITH lines AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate FROM lineitem),
         days AS (SELECT l_returnflag, o_orderdate, max(o_orderkey) AS newest
                  FROM orders, (SELECT DISTINCT l_returnflag FROM lineitem) GROUP BY l_returnflag, o_orderdate)
    SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag, l.l_shipdate, d.o_orderdate, coalesce(d.newest, -1) AS newest
    FROM lines l ASOF LEFT JOIN days d ON l.l_returnflag = d.l_returnflag AND l.l_shipdate >= d.o_orderdate""")
def join_asof_hot_key(t):
    """Three keys for all order lines: each sorts in as many tasks as it has slices."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    flags = F.broadcast(t.lineitem.select("l_returnflag").distinct())       # one letter each
    days = t.orders.groupBy("o_orderdate").agg(F.max("o_orderkey").alias("newest")).crossJoin(flags)
    return asof_join(lines, days, "l_returnflag", "l_shipdate", "o_orderdate", slices=64).withColumn("newest", F.coalesce("newest", F.lit(-1)))


@query("join_interval", """
    SELECT a.o_custkey, a.o_orderkey, a.o_orderdate, b.offer, b.opens, b.closes
    FROM orders a JOIN (
        SELECT o_custkey, o_orderkey AS offer, o_orderdate AS opens, o_orderdate + to_days(CAST(o_orderkey % 700 AS INTEGER)) AS closes FROM orders) b
      ON a.o_custkey = b.o_custkey AND a.o_orderdate >= b.opens AND a.o_orderdate < b.closes""")
def join_interval(t):
    """Every order opens an offer of 0 to 699 days; which orders fall into which of the customer's offers?"""
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    days = F.make_dt_interval((F.col("o_orderkey") % 700).cast("int"))
    offers = t.orders.select("o_custkey", F.col("o_orderkey").alias("offer"), F.col("o_orderdate").alias("opens"), (F.col("o_orderdate") + days).alias("closes"))
    return interval_join(orders, offers, "o_custkey", "o_orderdate", "opens", "closes", width=86_400_000_000)


@query("join_band", """
    SELECT c_custkey, c_acctbal, s_suppkey, s_acctbal FROM customer JOIN supplier ON abs(c_acctbal - s_acctbal) <= 12.5""")
def join_band(t):
    """Customers and suppliers whose balances differ by at most 12.50: no key is equal."""
    return band_join(t.customer.select("c_custkey", "c_acctbal"), t.supplier.select("s_suppkey", "s_acctbal"), "c_acctbal", "s_acctbal", 12.5)
