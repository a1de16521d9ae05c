"""CSV and Parquet files under any path Spark's file systems understand."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# The file formats a source or target may name.
FILE_FORMATS = ("csv", "parquet")


def check_files(config: Mapping[str, Any], what: str) -> None:
    if not config.get("path"):
        raise ValueError(f"{what} needs a 'path'")
    fmt = config.get("format")
    if not fmt or str(fmt).lower() not in FILE_FORMATS:
        raise ValueError(f"{what} needs a 'format', one of {FILE_FORMATS}, not {fmt!r}")
    if not isinstance(config.get("options") or {}, Mapping):
        raise ValueError(f"{what}: 'options' must be a mapping")


def read_files(spark: SparkSession, path: str | list[str], format: str,
               options: Mapping[str, Any] | None = None, schema: Any = None) -> DataFrame:
    """Scan files. ``schema`` (DDL text or StructType) saves the inference pass over the data."""
    reader = spark.read.format(format.lower()).options(**dict(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def path_is_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"
