"""Sources by type name, and reading a target back."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from millrace.sources.files import check_files, path_is_missing, read_files
from millrace.sources.jdbc import check_jdbc_source, jdbc_table_exists, read_jdbc

Config = Mapping[str, Any]


def _database(db_type: str | None):
    def check(config: Config) -> None:
        check_jdbc_source(_typed(config), f"{db_type or 'jdbc'} source")

    def read(spark: SparkSession, config: Config) -> DataFrame:
        return read_jdbc(spark, _typed(config))

    def _typed(config: Config) -> dict[str, Any]:
        return {**config, "db_type": db_type} if db_type else dict(config)

    return check, read


def _files(format: str | None):
    def _typed(config: Config) -> dict[str, Any]:
        return {**config, "format": format} if format else dict(config)

    def check(config: Config) -> None:
        check_files(_typed(config), "file source")

    def read(spark: SparkSession, config: Config) -> DataFrame:
        c = _typed(config)
        committed = _committed_rows(spark, c["path"])
        if committed is not None:
            return committed
        return read_files(spark, c["path"], c["format"], c.get("options"), c.get("schema"))

    return check, read


def _committed_rows(spark: SparkSession, path: Any) -> DataFrame | None:
    """The current rows of a folder that flows commit loads to; None for any other path."""
    from millrace.sinks.snapshots import SnapshotFolder

    if not isinstance(path, str) or any(c in path for c in "*?[{"):
        return None
    return SnapshotFolder(spark, path).read()


def _need(key: str, what: str) -> Callable[[Config], None]:
    def check(config: Config) -> None:
        if not config.get(key):
            raise ValueError(f"{what} source needs {key!r}")

    return check


def _read_table(spark: SparkSession, config: Config) -> DataFrame:
    return spark.read.table(config["table"])


def _read_iceberg(spark: SparkSession, config: Config) -> DataFrame:
    return spark.read.format("iceberg").load(config["path"])


def _read_snapshot(spark: SparkSession, config: Config) -> DataFrame:
    from millrace.sinks.snapshots import SnapshotFolder

    found = SnapshotFolder(spark, config["path"]).read()
    if found is None:
        raise ValueError(f"nothing has been committed at {config['path']}")
    return found


# Source types: how each checks its configuration and how it reads.
SOURCES: dict[str, tuple[Callable[[Config], None], Callable[[SparkSession, Config], DataFrame]]] = {
    "mysql": _database("mysql"),
    "postgresql": _database("postgresql"),
    "mssql": _database("mssql"),
    "jdbc": _database(None),
    "s3": _files(None),
    "files": _files(None),
    "csv": _files("csv"),
    "parquet": _files("parquet"),
    "table": (_need("table", "table"), _read_table),
    "iceberg": (_need("path", "iceberg"), _read_iceberg),
    "snapshot": (_need("path", "snapshot"), _read_snapshot),
}


def source_type(name: Any) -> str:
    kind = str(name or "").lower()
    if kind not in SOURCES:
        raise ValueError(f"source type {name!r} is not one of {sorted(SOURCES)}")
    return kind


def check_source(kind: str, config: Config) -> None:
    SOURCES[source_type(kind)][0](config)


def read_source(spark: SparkSession, kind: str, config: Config) -> DataFrame:
    check, read = SOURCES[source_type(kind)]
    check(config)
    return read(spark, config)


def reading_settings(config: Config) -> dict[str, Any]:
    """A JDBC target's settings for reading it back: ``num_partitions`` alone bounds writing, and splits no scan."""
    out = {**config, "query": None}
    if not config.get("partition_column"):
        out.pop("num_partitions", None)
    return out


def read_target(spark: SparkSession, kind: str, config: Config) -> DataFrame | None:
    """What a target holds now, or None if it does not exist yet. Any other failure is raised."""
    from millrace.sinks import target_type
    from millrace.sinks.files import recover_table
    from millrace.sinks.snapshots import SnapshotFolder

    kind = target_type(kind)
    if kind == "jdbc":
        return read_jdbc(spark, reading_settings(config)) if jdbc_table_exists(spark, config) else None
    if kind == "table":
        name = config["table"]
        recover_table(spark, name)
        return spark.read.table(name) if spark.catalog.tableExists(name) else None
    if kind == "iceberg":
        path = config["path"]
        try:
            return spark.read.format("iceberg").load(path)
        except AnalysisException as error:
            if path_is_missing(error) or error.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
                return None
            raise
    committed = SnapshotFolder(spark, config["path"]).read()
    if committed is not None:
        return committed
    try:
        return read_files(spark, config["path"], config["format"],
                          config.get("options"), config.get("schema"))
    except AnalysisException as error:
        if path_is_missing(error):
            return None
        raise
