"""Shared scratch folder and staging of increments.

An increment is used several times in one load (key check, matching, insert). Staging it once as
Parquet in the cluster's shared folder fixes its contents, cuts the lineage back to the source
database and lets Spark see its true size. A lost executor re-reads files, not the source.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An increment up to this many bytes and rows may be broadcast; a hash table costs more per row than its columns.
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 1_000_000

_CHECKPOINT_DIR = "spark.checkpoint.dir"


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="millrace-")


def shared_folder(spark: SparkSession, name: str = "work") -> str:
    """A new path under ``spark.checkpoint.dir``. Nothing is created yet."""
    root = spark.conf.get(_CHECKPOINT_DIR, None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set {_CHECKPOINT_DIR} to a folder every executor can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"


def literal_rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A few rows of bookkeeping as one constant of the plan; no Python worker is started for them."""
    text = json.dumps(rows, default=str)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"ARRAY<STRUCT<{ddl}>>")))


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(0).select(*columns)


@dataclass(frozen=True)
class Staged:
    frame: DataFrame
    rows: int
    bytes: int
    path: str | None = None
    limit: int | None = None            # bytes; BROADCAST_BYTES if not set

    @property
    def small(self) -> bool:
        return self.bytes <= (BROADCAST_BYTES if self.limit is None else self.limit) and self.rows <= BROADCAST_ROWS

    def discard(self) -> None:
        """Delete the copy. Frames made from it cannot be read any more."""
        if self.path:
            delete_folder(self.frame.sparkSession, self.path)


def row_bytes(schema: T.StructType) -> Column:
    """Rough size of a row: texts as long as they are, arrays and maps by their sizes, anything else 8 bytes."""
    total = F.lit(0).cast("bigint")
    for field in schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            total = total + F.coalesce(F.size(column), F.lit(0)) * _width(field.dataType)
        else:
            total = total + _width(field.dataType)
    return total


def _width(dtype: T.DataType) -> int:
    """A guess at the bytes of one value (of one element, for arrays and maps)."""
    if isinstance(dtype, T.ArrayType):
        return _width(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _width(dtype.keyType) + _width(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return sum(_width(f.dataType) for f in dtype.fields)
    return 32 if isinstance(dtype, (T.StringType, T.BinaryType)) else 8


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str = "increment", limit: int | None = None) -> Staged:
    """Write ``df`` once to the shared folder; count and measure it during that same write."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    seen = Observation(f"stage-{uuid.uuid4().hex}")
    size = F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0))
    (df.observe(seen, F.count(F.lit(1)).alias("rows"), size.alias("bytes"))
       .write.mode("errorifexists").parquet(path))
    return Staged(spark.read.schema(df.schema).parquet(path), seen.get["rows"], seen.get["bytes"], path, limit)
