"""From raw documents to token ids: rules, exact copies, near copies, mixing, tokens.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, folder of the tables) and returns a DataFrame. Each
stage works on all rows its predecessor kept; all but the last return the columns of ``documents``. Stages that
compare documents write their small tables to the shared folder; between stages :func:`run` writes the rows themselves.

Defined cases are those of the operators: an empty table passes through as an empty table, NULL and empty texts
end at the first stage, rows that repeat an id are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, mixing, near_dedup, pieces, quality_rules
from millrace.llm.common import scratch, ship, staged
from millrace.llm.queries import PIECE_MODEL


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or read unlike trusted text, go."""
    return quality_rules.keep_good(docs, ship(spark).read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays; the digests of those that stay are appended to an index of this corpus."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    ship(spark)
    return near_dedup.drop_near_copies(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document may be there up to three times."""
    return mixing.mixed(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix as token ids."""
    ship(spark)
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), PIECE_MODEL)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_ids"), "ids")


STAGES = [
    ("quality_rules", rules_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("sentencepiece", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # What a stage staged inside is deleted when its rows are written.
        with scratch(spark):
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)


# The likelihood ratio, near copies and token ids have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
