"""Exact deduplication against a persistent digest index.

The index is a table of one row per text ever kept, bucketed and sorted by digest. A batch is reduced to
its digests, each digest to the row that stays (partial aggregates: a text that fills a third of the batch
is one row per task before the shuffle), digests known to the index fall away in a sort-merge anti-join
that reads the index without a shuffle, and the rest is appended. Verdicts need no text in a shuffle. Each batch adds
a file to every bucket it reaches; ``compact_index`` makes one sorted file of each bucket again.

Defined cases: NULL text is the empty text; empty texts are equal to each other; a NULL id loses every tie;
rows that repeat id, digest and length are one unit, of which the first copy stays; an empty batch
appends nothing; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.workspace import shared_folder
from millrace.llm.common import BLANK, same, staged, text_of

INDEX = T.StructType([T.StructField("text_sha256", T.StringType()),
                      T.StructField("keep_id", T.LongType()),
                      T.StructField("n_points", T.LongType())])

_BY_BUCKET = "spark.sql.sources.bucketing.autoBucketedScan.enabled"


def open_index(spark: SparkSession, table: str, location: str, buckets: int) -> str:
    """Create the index table at ``location``, or register the one whose files are there (with the same buckets)."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in INDEX.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (text_sha256) "
              f"SORTED BY (text_sha256) INTO {int(buckets)} BUCKETS LOCATION '{_literal(location)}'")
    return table


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, code points of the whole text, digest of the text without white space."""
    text = text_of(text_column)
    return docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
        F.length(text).cast("bigint").alias("n_points"),
        F.sha2(F.regexp_replace(text, f"[{BLANK}]+", ""), 256).alias("text_sha256"))


def _units(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "n_points", "text_sha256").agg(F.count(F.lit(1)).alias("rows"))


def judge(docs: DataFrame, index: str, buckets: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Deduplicate ``docs`` in themselves and against ``index``, and append the new texts to it.

    Returns one row per unit (see the module): doc_id, n_points, text_sha256, rows, keep_id, group_size
    (rows of this batch with that text) and stays (this unit's first row is the one kept).
    """
    spark = docs.sparkSession
    units = staged(_units(digests(docs, id_column, text_column)), "digests")
    first = F.min(F.struct((-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"),
                           F.col("doc_id").alias("id")))
    groups = (units.groupBy("text_sha256").agg(first.alias("first"), F.sum("rows").alias("group_size"))
              .select("text_sha256", F.col("first.id").alias("first_id"),
                      (-F.col("first.shorter")).alias("first_points"), "group_size"))
    groups = staged(groups, "digest-groups")
    known = spark.table(index)
    fresh = staged(groups.join(known.hint("merge"), "text_sha256", "left_anti"), "digest-new")
    old = (groups.join(known.hint("merge"), "text_sha256")
           .select("text_sha256", "keep_id", F.lit(None).cast("bigint").alias("keep_points"), "group_size"))
    decided = staged(fresh.select("text_sha256", F.col("first_id").alias("keep_id"),
                                  F.col("first_points").alias("keep_points"), "group_size").unionByName(old),
                     "digest-verdicts")
    (fresh.select("text_sha256", F.col("first_id").alias("keep_id"), F.col("first_points").alias("n_points"))
     .repartition(buckets, "text_sha256").write.mode("append").bucketBy(buckets, "text_sha256")
     .sortBy("text_sha256").saveAsTable(index))
    stays = F.coalesce((F.col("n_points") == F.col("keep_points")) & same(F.col("doc_id"), F.col("keep_id")), F.lit(False))
    return units.join(decided, "text_sha256").select(
        "doc_id", "n_points", "text_sha256", "rows", "keep_id", "group_size", stays.alias("stays"))


def new_index(spark: SparkSession) -> tuple[str, int]:
    """An index for one corpus: its name, and as many buckets as the session has shuffle partitions."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"digests_{uuid.uuid4().hex}"
    return open_index(spark, table, shared_folder(spark, "digest-index"), buckets), buckets


def compact_index(spark: SparkSession, index: str, buckets: int) -> str:
    """Rewrite the index as one sorted file per bucket in a new folder, which is returned; no row leaves its bucket's task.

    The table is pointed to the new folder in one step when all is written: readers see the old files or the new ones. The old
    folder is left for readers that are under way; ``open_index`` in another session takes the returned one.
    """
    place = shared_folder(spark, "digest-index")
    whole = f"{index}_{uuid.uuid4().hex}"
    columns = [f.name for f in INDEX.fields]
    before = spark.conf.get(_BY_BUCKET)
    spark.conf.set(_BY_BUCKET, "false")                     # else the scan is by file, and every file writes to its bucket
    try:
        (spark.table(index).select(*columns).repartition(buckets, "text_sha256").write.mode("errorifexists").option("path", place)
         .bucketBy(buckets, "text_sha256").sortBy("text_sha256").saveAsTable(whole))
    finally:
        spark.conf.set(_BY_BUCKET, before)
    spark.sql(f"ALTER TABLE {index} SET LOCATION '{_literal(place)}'")
    spark.catalog.refreshTable(index)
    spark.sql(f"DROP TABLE {whole}")                        # external: the files stay
    return place


def verdicts(docs: DataFrame, index: str | None = None, buckets: int | None = None) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    if index is None:
        index, buckets = new_index(docs.sparkSession)
    copies = judge(docs, index, buckets).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    return copies.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"),
                         "text_sha256")


def drop_copies(docs: DataFrame, index: str | None = None, buckets: int | None = None) -> DataFrame:
    """The documents that stay, all columns as they were."""
    if index is None:
        index, buckets = new_index(docs.sparkSession)
    stay = staged(judge(docs, index, buckets).where("stays").select("doc_id", "n_points", "text_sha256", "rows"),
                  "digest-stay")
    mark = f"unit_{uuid.uuid4().hex}"
    text = text_of()
    marked = docs.withColumn(mark, F.struct(F.length(text).cast("bigint").alias("n"),
                                            F.sha2(F.regexp_replace(text, f"[{BLANK}]+", ""), 256).alias("sha")))

    def unit_in(units: DataFrame) -> Column:
        return ((F.col(f"{mark}.sha") == units.text_sha256) & (F.col(f"{mark}.n") == units.n_points)
                & same(F.col("doc_id").cast("bigint"), units.unit_id))

    units = stay.withColumnRenamed("doc_id", "unit_id")
    kept = marked.join(units, unit_in(units), "left_semi")
    repeated = units.where("rows > 1")
    if repeated.isEmpty():
        return kept.drop(mark)
    once = marked.join(repeated, unit_in(repeated), "left_semi").dropDuplicates([mark, "doc_id"])
    return kept.join(repeated, unit_in(repeated), "left_anti").unionByName(once).drop(mark)
