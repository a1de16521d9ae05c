"""What the corpus operators share: word patterns, staging in the shared folder, small tables on every executor."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.workspace import delete_folder, shared_folder

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

PACKAGE = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()

# The white space of all word rules, for Java's and Python's regular expressions alike.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"

# A table of at most this many rows (and narrow columns) is sent to every executor; a larger one is shuffled.
BROADCAST_ROWS = 50_000


def ship(spark: SparkSession) -> SparkSession:
    """Hand the package's source to the executors, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED and PACKAGE.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="millrace-source-")) / "millrace.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(PACKAGE.rglob("*.py")):
                out.write(file, Path(PACKAGE.name) / file.relative_to(PACKAGE))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


def text_of(name: str = "text") -> Column:
    """The whole text, NULL as the empty one."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


# Folders that were staged inside of each open scratch(), the innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, but for lasting ones, which go with the scratch around this one, if any.

    Frames that read a deleted table must not be used any more.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete_folder(spark, path)


def staged(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read from there: fixed rows, short lineage, known size.

    The write's shuffle files go as soon as it is done, as nothing else can read them.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    level = len(_OPEN) - (2 if lasting else 1)
    if level >= 0:
        _OPEN[level].append(path)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count of its (staged) rows proves it short, unchanged otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)
