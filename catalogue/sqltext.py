"""SQL blocks, Python steps, and the relational features SQL text passes on to Spark."""

import pandas as pd
from pyspark.sql import functions as F

from catalogue import query
from millrace import not_null, register_transform, sql_block
from millrace.functions.transforms import chain, python_step, sql_step

_ENRICH = """
    -- shipping labels: one upper-cased line, and how a line is to be handled
    CREATE OR REPLACE TEMP VIEW labelled AS
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, UPPER(concat(l_returnflag, '/', l_linestatus)) AS mark,
           CASE WHEN l_quantity >= 40 THEN 'pallet' WHEN l_quantity >= 10 THEN 'box' ELSE 'letter' END AS parcel
    FROM temp_table;
    SELECT * FROM labelled;
"""


@query("sql_enrich_case", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, UPPER(concat(l_returnflag, '/', l_linestatus)) AS mark,
           CASE WHEN l_quantity >= 40 THEN 'pallet' WHEN l_quantity >= 10 THEN 'box' ELSE 'letter' END AS parcel
    FROM lineitem""")
def sql_enrich_case(t):
    return sql_block(t.lineitem, _ENRICH)


@query("sql_literal_semicolon", """
    SELECT p_partkey, concat(p_name, ';') AS name, '--' AS dashes FROM part""")
def sql_literal_semicolon(t):
    return sql_block(t.part, """
        /* a ; in a comment /* and ; in one inside it */ ; */
        SELECT p_partkey, concat(p_name, ';') AS name, '--' AS dashes -- one more ; here
        FROM temp_table;
        -- the end
    """)


@query("sql_chain_same_view", """
    SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders
    WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING COUNT(*) > 2""")
def sql_chain_same_view(t):
    return chain(t.orders, [
        sql_step("""CREATE OR REPLACE TEMP VIEW step AS
                    SELECT * FROM temp_table WHERE o_orderstatus <> 'P';
                    SELECT o_custkey, o_totalprice FROM step"""),
        sql_step("""CREATE OR REPLACE TEMP VIEW step AS
                    SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS top
                    FROM temp_table GROUP BY o_custkey;
                    SELECT * FROM step WHERE n > 2"""),
    ])


@register_transform("price_band")
def price_band(df, column, edges):
    """The number of ``edges`` that a price reaches, and the type's first word."""
    band = sum((F.when(F.col(column) >= edge, 1).otherwise(0) for edge in edges), F.lit(0))
    return df.withColumn("band", band).withColumn("family", F.lower(F.substring_index("p_type", " ", 1)))


@query("py_price_band", """
    SELECT p_partkey, p_type, p_retailprice, CAST((p_retailprice >= 950)::INT + (p_retailprice >= 1200)::INT AS INTEGER) AS band,
           lower(split_part(p_type, ' ', 1)) AS family FROM part""")
def py_price_band(t):
    rows = t.part.select("p_partkey", "p_type", "p_retailprice")
    return rows.transform(python_step("price_band", {"column": "p_retailprice", "edges": [950, 1200]}))


@query("py_not_null", """
    SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)
    WHERE l.quality IS NOT NULL AND d.lang IS NOT NULL""")
def py_not_null(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "quality")
    return not_null(rows, ["quality", "lang"])


@query("py_pandas_udf", """
    SELECT o_orderkey, o_totalprice * 1.19 + 4 AS gross FROM orders""")
def py_pandas_udf(t):
    @F.pandas_udf("double")
    def gross(price: pd.Series) -> pd.Series:
        return price * 1.19 + 4

    return t.orders.transform(lambda df: df.select("o_orderkey", gross("o_totalprice").alias("gross")))


def passthrough(name, sql, *tables, spark_sql=None):
    """SQL that means the same to Spark and DuckDB, run as a block over the given tables.

    The first table is the block's input; the others are views of their own while it is analyzed.
    """

    @query(f"passthrough_{name}", sql)
    def run(t):
        text = spark_sql or sql
        first, *others = tables
        for other in others:
            getattr(t, other).createOrReplaceTempView(other)
        try:
            return sql_block(getattr(t, first), text, view=first)
        finally:
            for other in others:
                t.spark.catalog.dropTempView(other)

    return run


passthrough("join_inner", """
    SELECT o_orderkey, o_totalprice, c_name, c_mktsegment
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0""", "orders", "customer")

passthrough("join_left", """
    SELECT c_custkey, COUNT(o_orderkey) AS n_orders
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000
    GROUP BY c_custkey""", "customer", "orders")

passthrough("join_semi", """
    SELECT c_custkey, c_name FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""",
            "customer", "orders")

passthrough("join_anti", """
    SELECT c_custkey, c_name FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""",
            "customer", "orders")

passthrough("join_full_outer", """
    SELECT COALESCE(d.doc_id, e.event_id) AS id, d.lang, e.event_type
    FROM documents d FULL OUTER JOIN events e ON d.doc_id = e.event_id""", "documents", "events")

passthrough("join_range", """
    SELECT o_orderkey, l_linenumber, l_partkey, o_orderdate, l_shipdate
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey
     AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL '30' DAY""", "orders", "lineitem")

passthrough("agg", """
    SELECT l_returnflag, l_linestatus,
           CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base,
           MIN(l_discount) AS least, MAX(l_tax) AS most, CAST(COUNT(*) AS BIGINT) AS n
    FROM lineitem GROUP BY l_returnflag, l_linestatus""", "lineitem")

passthrough("distinct", """
    SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem""", "lineitem")

passthrough("rollup", """
    SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS n, MAX(l_extendedprice) AS top
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""", "lineitem")

passthrough("cube", """
    SELECT o_orderstatus, o_orderpriority, CAST(COUNT(*) AS BIGINT) AS n
    FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""", "orders")

passthrough("grouping_sets", """
    SELECT o_orderstatus, o_orderpriority, CAST(COUNT(*) AS BIGINT) AS n
    FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""", "orders")

passthrough("window", """
    SELECT o_orderkey, o_custkey,
           CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS nth,
           lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before
    FROM orders""", "orders")

passthrough("topk", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""", "orders")

passthrough("intersect", """
    SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'
    INTERSECT SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O'""", "lineitem")

passthrough("except", """
    SELECT c_custkey AS k FROM customer
    EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""", "customer", "orders")

passthrough("union_all", """
    SELECT c_name AS name, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_name, s_acctbal FROM supplier""", "customer", "supplier")

passthrough("scalar_string", """
    SELECT p_partkey, UPPER(p_name) AS up, CAST(LENGTH(p_name) AS INTEGER) AS len, SUBSTRING(p_type, 1, 5) AS head,
           REPLACE(p_brand, '#', '-') AS brand, TRIM(concat('  ', p_name, ' ')) AS trimmed
    FROM part""", "part")

passthrough("scalar_date", """
    SELECT o_orderkey, CAST(YEAR(o_orderdate) AS INTEGER) AS y, CAST(MONTH(o_orderdate) AS INTEGER) AS m,
           CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, o_orderdate + INTERVAL '7' DAY AS week_later
    FROM orders""", "orders")

passthrough("scalar_math", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ABS(l_discount - l_tax) AS gap, FLOOR(l_quantity / 7) AS sevenths,
           SQRT(l_quantity) AS root, COALESCE(NULLIF(l_tax, 0), -1) AS tax
    FROM lineitem""", "lineitem", spark_sql="""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ABS(l_discount - l_tax) AS gap,
           CAST(FLOOR(l_quantity / 7) AS DOUBLE) AS sevenths,
           SQRT(l_quantity) AS root, COALESCE(NULLIF(l_tax, 0), -1) AS tax
    FROM lineitem""")

passthrough("scalar_json", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""", "events",
            spark_sql="SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events")

passthrough("scalar_array", """
    SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS width, embedding[1] AS first_value,
           list_max(embedding) AS top
    FROM embeddings""", "embeddings", spark_sql="""
    SELECT vec_id, label, size(embedding) AS width, embedding[0] AS first_value,
           array_max(embedding) AS top
    FROM embeddings""")

passthrough("scalar_map", """
    SELECT o_orderkey, o_orderstatus || ':' || o_orderpriority AS joined, CAST(2 AS INTEGER) AS entries,
           o_orderpriority AS priority FROM orders""", "orders", spark_sql="""
    SELECT o_orderkey, concat_ws(':', map_values(m)) AS joined, size(map_keys(m)) AS entries, m['priority'] AS priority
    FROM (SELECT o_orderkey, map('status', o_orderstatus, 'priority', o_orderpriority) AS m FROM orders)""")
