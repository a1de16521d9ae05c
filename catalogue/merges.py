"""Upserts."""

from pyspark.sql import functions as F

from catalogue import query
from millrace import latest_per_key, upsert
from millrace.functions.workspace import stage

_SPLIT = "1998-10-03"


def _split_at(moment=_SPLIT):
    return F.lit(moment).cast("timestamp_ntz")


def _newest_order(rows):
    return latest_per_key(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")


@query("upsert_single_key", """
    SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
        FROM orders) WHERE rn = 1""")
def upsert_single_key(t):
    """Newest order of each customer: those before the split, updated by those after it."""
    old = _newest_order(t.orders.filter(F.col("o_orderdate") < _split_at()))
    new = _newest_order(t.orders.filter(F.col("o_orderdate") >= _split_at()))
    return upsert(old, new, "o_custkey")


@query("upsert_measured_source", """
    SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
        FROM orders) WHERE rn = 1""")
def upsert_measured_source(t):
    """The same with a staged source, broadcast only if its measured size allows it."""
    old = _newest_order(t.orders.filter(F.col("o_orderdate") < _split_at()))
    new = stage(_newest_order(t.orders.filter(F.col("o_orderdate") >= _split_at())))
    return upsert(old, new.frame, "o_custkey", broadcast_source=new.small)


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
         "l_shipdate")


@query("upsert_composite_key", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY (l_shipdate >= TIMESTAMP '1998-10-03') DESC, l_shipdate DESC, l_partkey DESC,
                     l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn
        FROM lineitem) WHERE rn = 1""")
def upsert_composite_key(t):
    """Order lines; the key repeats, so the newest of each is taken on both sides."""
    keys = ["l_orderkey", "l_linenumber"]
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = t.lineitem.select(*_LINE)
    old = latest_per_key(lines.filter(F.col("l_shipdate") < _split_at()), keys, order)
    return upsert(old, lines.filter(F.col("l_shipdate") >= _split_at()), keys, order_by=order)


_REVIEWED = """
    docs AS (SELECT CAST(l.doc_id AS VARCHAR) AS k, 'doc' AS kind, d.doc_id AS id FROM documents d LEFT JOIN labels l USING (doc_id)),
    web AS (SELECT CAST(l.doc_id AS VARCHAR) AS k, 'page' AS kind, p.page_id AS id FROM pages p LEFT JOIN labels l ON p.page_id = l.doc_id)"""


def reviewed(t):
    """Documents and pages under the label they carry; most carry none, so most keys are NULL."""
    labels = t.labels.select(F.col("doc_id").alias("label"), F.col("doc_id").cast("string").alias("k"))
    docs = t.documents.join(labels, F.col("doc_id") == F.col("label"), "left").select(
        "k", F.lit("doc").alias("kind"), F.col("doc_id").alias("id"))
    web = t.pages.join(labels, F.col("page_id") == F.col("label"), "left").select(
        "k", F.lit("page").alias("kind"), F.col("page_id").alias("id"))
    return docs, web


@query("upsert_null_keys", f"""
    WITH {_REVIEWED}
    SELECT * FROM docs WHERE k IS NULL OR k NOT IN (SELECT k FROM web WHERE k IS NOT NULL)
    UNION ALL SELECT * FROM web""")
def upsert_null_keys(t):
    docs, web = reviewed(t)
    return upsert(docs, web, "k")


@query("upsert_null_safe", f"""
    WITH {_REVIEWED}, one AS (
        SELECT k, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id DESC) AS rn FROM web)
        WHERE rn = 1)
    SELECT * FROM docs d WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.k IS NOT DISTINCT FROM d.k)
    UNION ALL SELECT * FROM one""")
def upsert_null_safe(t):
    docs, web = reviewed(t)
    return upsert(docs, web, "k", order_by="id", null_safe=True)


@query("upsert_repeated_target_keys", """
    WITH news AS (
        SELECT o_orderkey AS l_orderkey, o_orderpriority AS note FROM orders
        WHERE o_orderdate >= TIMESTAMP '1998-10-03')
    SELECT l.l_orderkey, COALESCE(n.note, l.l_returnflag) AS note
    FROM lineitem l LEFT JOIN news n ON l.l_orderkey = n.l_orderkey
    UNION ALL
    SELECT l_orderkey, note FROM news WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def upsert_repeated_target_keys(t):
    """A target that holds a key many times: each of its rows is updated, as MERGE does."""
    old = t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("note"))
    news = t.orders.filter(F.col("o_orderdate") >= _split_at()).select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("note"))
    return upsert(old, news, "l_orderkey", repeated_target_keys=True)
