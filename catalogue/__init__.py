"""Registered queries: each runs the library over whole tables, most with an equal DuckDB query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


class Tables:
    """The given tables of one scale factor, read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` with the SQL that must give the same rows."""

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query {name!r} is registered twice")
        ENTRIES[name] = Entry(lambda spark, folder: fn(Tables(spark, folder)), sql)
        return fn

    return keep


def load_all() -> dict[str, Entry]:
    from catalogue import (capture, dimensions, flows, merges, nearness, scans, sqltext, streams,  # noqa: F401
                           versioned)

    return ENTRIES
