import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millrace import not_null, split_sql, sql_block
from millrace.functions.sqltext import created_temp_view
from millrace.functions.transforms import chain, python_step, sql_step


@pytest.mark.parametrize("text, expected", [
    ("SELECT 1; SELECT 2", ["SELECT 1", "SELECT 2"]),
    ("SELECT ';' AS a;", ["SELECT ';' AS a"]),
    ('SELECT "a;b"', ['SELECT "a;b"']),
    ("SELECT `a;b` FROM t", ["SELECT `a;b` FROM t"]),
    ("SELECT 1 -- x; y\n; SELECT 2", ["SELECT 1", "SELECT 2"]),
    ("SELECT /* a; b */ 1", ["SELECT   1"]),
    ("SELECT /*+ BROADCAST(t) */ * FROM t", ["SELECT /*+ BROADCAST(t) */ * FROM t"]),
    ("SELECT 'it''s; ok'; SELECT 3", ["SELECT 'it''s; ok'", "SELECT 3"]),
    (r"SELECT 'a\'; b'", [r"SELECT 'a\'; b'"]),
    ("SELECT 4 - 1, 6/2", ["SELECT 4 - 1, 6/2"]),
    (";;  ; -- nothing\n", []),
    ("", []),
])
def test_split(text, expected):
    assert split_sql(text) == expected


@pytest.mark.parametrize("text, name", [
    ("CREATE OR REPLACE TEMP VIEW parcels AS SELECT 1", "parcels"),
    ("create temporary view if not exists `a b` as select 1", "a b"),
    ("SELECT 1", None), ("CREATE TABLE t (a INT)", None)])
def test_created_view(text, name):
    assert created_temp_view(text) == name


def test_block_errors(spark):
    df = spark.range(3)
    with pytest.raises(ValueError, match="no statement"):
        sql_block(df, " ; -- only this")
    with pytest.raises(ValueError, match="end in a query"):
        sql_block(df, "CREATE OR REPLACE TEMP VIEW last_one AS SELECT * FROM temp_table")
    with pytest.raises(AnalysisException):
        sql_block(df, "SELECT missing FROM temp_table")
    assert not spark.catalog.tableExists("temp_table") and not spark.catalog.tableExists("last_one")


def test_views_are_given_back(spark, rows):
    spark.range(5).createOrReplaceTempView("parcels")
    out = sql_block(spark.range(2), """CREATE OR REPLACE TEMP VIEW parcels AS SELECT id + 10 AS id FROM temp_table;
                                       SELECT * FROM parcels""")
    assert rows(out) == [(10,), (11,)]
    assert spark.table("parcels").count() == 5
    spark.catalog.dropTempView("parcels")


def test_chained_blocks_reuse_names(spark, rows):
    block = sql_step("CREATE OR REPLACE TEMP VIEW v AS SELECT id * 2 AS id FROM temp_table; SELECT * FROM v")
    assert rows(chain(spark.range(3), [block, block])) == [(0,), (4,), (8,)]


def test_python_steps(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, "y")], "a INT, b STRING")
    assert rows(not_null(df, "b")) == [(2, "x"), (None, "y")]
    assert rows(not_null(df)) == [(2, "x")]                     # unnamed columns: all of them
    assert rows(df.transform(python_step("not_null", {"columns": ["a", "b"]}))) == [(2, "x")]
    with pytest.raises(ValueError, match="no transform is registered"):
        python_step("unheard_of")


def test_case_takes_the_last_branch_for_null(spark, rows):
    df = spark.createDataFrame([(None,), (12,)], "weight INT")
    out = sql_block(df, "SELECT CASE WHEN weight >= 10 THEN 'box' ELSE 'letter' END AS parcel FROM temp_table")
    assert rows(out) == [("box",), ("letter",)]


def test_block_comments_nest():
    assert split_sql("/* a /* b */ ; c */ SELECT 1; SELECT 2") == ["SELECT 1", "SELECT 2"]
    assert split_sql("SELECT /*+ BROADCAST(t) */ 1; /* open /* never closed */ ;") == ["SELECT /*+ BROADCAST(t) */ 1"]
    assert split_sql("SELECT '/*' AS a; SELECT 1 - 2 / 3") == ["SELECT '/*' AS a", "SELECT 1 - 2 / 3"]


def test_no_python_in_the_plan(spark):
    plan = sql_block(spark.range(9).filter(F.col("id") > 3), "SELECT UPPER(CAST(id AS STRING)) AS s FROM temp_table")
    assert "Python" not in plan._jdf.queryExecution().toString()
