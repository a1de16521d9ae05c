"""Plain CSV and Parquet targets, catalog tables and JDBC tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from millrace.functions.workspace import delete_folder, stage
from millrace.sources.dialects import check_connection, connection_options

# The save modes Spark knows, and the one added here.
SAVE_MODES = ("append", "overwrite", "ignore", "error", "errorifexists", "default")
MERGE = "merge"
DEFAULT_MODE = "append"
_GENERATION = "__g"
_DYNAMIC = "spark.sql.sources.partitionOverwriteMode"


def mode_of(config: Mapping[str, Any], what: str, allowed: Sequence[str] = SAVE_MODES) -> str:
    mode = str(config.get("mode") or DEFAULT_MODE).lower()
    if mode not in allowed:
        raise ValueError(f"{what}: mode {mode!r} is not one of {tuple(allowed)}")
    return mode


def write_files(df: DataFrame, path: str, format: str, mode: str = DEFAULT_MODE,
                options: Mapping[str, Any] | None = None,
                partition_by: Sequence[str] = ()) -> None:
    """Write files; with ``partition_by`` the rows are first rebalanced on those columns.

    The rebalance hint lets Spark merge small and split large partition values at run time, so a
    value that holds a third of all rows is written by many tasks.

    ``overwrite`` writes aside and swaps folders when all is written: a job that fails leaves the old rows, and
    the rows may come from ``path`` itself. With the option ``partitionOverwriteMode: dynamic`` only the partitions
    that the rows fall into are replaced; these the rows may not come from.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    options = dict(options or {})
    swap = mode == "overwrite" and not (partition_by and _only_partitions(options))
    there = f"{_parent(path)}/.{path.rstrip('/').rsplit('/', 1)[-1]}-{uuid.uuid4().hex[:12]}" if swap else path
    writer = df.write.format(format.lower()).mode("errorifexists" if swap else mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if not swap:
        writer.save(path)
        return
    try:
        writer.save(there)
    except BaseException:
        delete_folder(df.sparkSession, there)
        raise
    _swap(df.sparkSession, there, path.rstrip("/"))


def _only_partitions(options: Mapping[str, Any] | None) -> bool:
    """Whether an overwrite is to replace only the partitions that the rows fall into."""
    found = {str(k).lower(): str(v).lower() for k, v in dict(options or {}).items()}
    return found.get("partitionoverwritemode") == "dynamic"


def _parent(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[0] if "/" in path.rstrip("/") else "."


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the folder ``fresh`` in the place of ``path``: two renames, and a third to undo the first if the second fails."""
    old = f"{fresh}-old"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = store.exists(place(path))
    if had and not store.rename(place(path), place(old)):
        raise RuntimeError(f"{path} cannot be moved aside")
    if not store.rename(place(fresh), place(path)):
        if had:
            store.rename(place(old), place(path))
        raise RuntimeError(f"{fresh} cannot be moved to {path}")
    if had:
        store.delete(place(old), True)
    spark.catalog.refreshByPath(path)


def check_jdbc_target(config: Mapping[str, Any]) -> None:
    check_connection(config, "jdbc target")
    if not config.get("table"):
        raise ValueError("jdbc target lacks table")
    mode_of(config, "jdbc target")


def jdbc_write_options(config: Mapping[str, Any]) -> dict[str, str]:
    out = connection_options(config)
    out["dbtable"] = config["table"]
    for ours, theirs in (("batchsize", "batchsize"), ("truncate", "truncate"),
                         ("num_partitions", "numPartitions"),
                         ("create_table_column_types", "createTableColumnTypes")):
        if config.get(ours) is not None:
            value = config[ours]
            out[theirs] = str(value).lower() if isinstance(value, bool) else str(value)
    out.update({str(k): str(v) for k, v in dict(config.get("options") or {}).items()})
    return out


def write_jdbc(df: DataFrame, config: Mapping[str, Any], mode: str | None = None) -> None:
    """Write to a database table; one connection per partition, at most ``num_partitions``."""
    check_jdbc_target(config)
    (df.write.format("jdbc").options(**jdbc_write_options(config))
       .mode(mode or mode_of(config, "jdbc target")).save())


def write_iceberg(df: DataFrame, path: str, mode: str, options: Mapping[str, Any] | None = None) -> None:
    """Append, or overwrite; with ``partitionOverwriteMode: dynamic`` only the partitions of the rows are overwritten."""
    if mode == "overwrite" and _only_partitions(options):
        df.writeTo(path).overwritePartitions()
    else:
        df.write.format("iceberg").mode(mode).save(path)


def write_table(df: DataFrame, table: str, mode: str, format: str = "parquet",
                options: Mapping[str, Any] | None = None, partition_by: Sequence[str] = ()) -> None:
    """Append to, create or replace a catalog table, matching columns by name.

    ``overwrite`` of a table that is there writes a second one and swaps them, so a job that fails leaves the old rows, and the
    rows may come from the table itself; tables with a ``path`` of the user's or in another catalog are left to Spark's writer,
    which keeps their place. With the option ``partitionOverwriteMode: dynamic`` only the partitions that the rows fall into
    are replaced.
    """
    spark = df.sparkSession
    if mode == "overwrite" and spark.catalog.tableExists(table):
        if _only_partitions(options) and _partition_columns(spark, table):
            _overwrite_partitions(df, table)
            return
        if "path" not in {str(k).lower() for k in dict(options or {})} and _in_session_catalog(spark, table):
            replace_table(df, table, format, options, partition_by)
            return
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(format).mode(mode).options(**dict(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)


def _in_session_catalog(spark: SparkSession, table: str) -> bool:
    parts = [a or b for a, b in re.findall(r"`([^`]+)`|([^.`]+)", table)]
    return (parts[0] if len(parts) > 2 else spark.catalog.currentCatalog()) == "spark_catalog"


def _partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def _overwrite_partitions(df: DataFrame, table: str) -> None:
    """Replace the partitions of ``table`` that rows of ``df`` fall into. Rows read from the table itself are staged first."""
    spark = df.sparkSession
    rows = df.select(*[f"`{c}`" for c in spark.table(quoted(table)).columns]).hint("rebalance", *_partition_columns(spark, table))
    before = spark.conf.get(_DYNAMIC)
    spark.conf.set(_DYNAMIC, "dynamic")         # the writer's own option does not reach inserts
    try:
        rows.write.mode("overwrite").insertInto(quoted(table))
    except AnalysisException as error:
        if error.getCondition() != "UNSUPPORTED_OVERWRITE.TABLE":
            raise
        own = stage(rows, "partitions")
        try:
            own.frame.write.mode("overwrite").insertInto(quoted(table))
        finally:
            own.discard()
    finally:
        spark.conf.set(_DYNAMIC, before)


def replace_table(df: DataFrame, table: str, format: str = "parquet",
                  options: Mapping[str, Any] | None = None,
                  partition_by: Sequence[str] = ()) -> None:
    """Replace a catalog table by rows computed from that same table.

    The rows go to a second table first; then two renames swap them. A run that dies in between
    leaves the old rows as ``<table>__old``, which ``recover_table`` puts back. With a ``path`` in
    ``options`` each generation has a folder of its own beside it, and the replaced one's files go.
    """
    spark = df.sparkSession
    fresh, old = f"{table}__new", f"{table}__old"
    options = dict(options or {})
    home = str(options["path"]).rstrip("/") if "path" in options else None
    replaced = None
    if home:
        options["path"] = f"{home}{_GENERATION}{uuid.uuid4().hex[:12]}"
        replaced = _location(spark, table) if spark.catalog.tableExists(table) else None
    if not spark.catalog.tableExists(table):
        write_table(df, quoted(table), "errorifexists", format, options, partition_by)
        return
    spark.sql(f"DROP TABLE IF EXISTS {quoted(fresh)}")
    write_table(df, quoted(fresh), "errorifexists", format, options, partition_by)
    spark.sql(f"DROP TABLE IF EXISTS {quoted(old)}")
    spark.sql(f"ALTER TABLE {quoted(table)} RENAME TO {_last_part(old)}")
    spark.sql(f"ALTER TABLE {quoted(fresh)} RENAME TO {_last_part(table)}")
    spark.sql(f"DROP TABLE IF EXISTS {quoted(old)}")
    if replaced and _is_generation(replaced, home):
        delete_folder(spark, replaced)


def _location(spark: SparkSession, table: str) -> str | None:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"] if rows else None


def _is_generation(location: str, home: str) -> bool:
    """Whether ``location`` is the folder ``home`` or one of its generations, however the scheme is written."""
    plain = re.sub(r"^file:/+", "/", location.rstrip("/"))
    return re.fullmatch(re.escape(re.sub(r"^file:/+", "/", home)) + f"({_GENERATION}[0-9a-f]{{12}})?", plain) is not None


def recover_table(spark: SparkSession, table: str) -> None:
    """Undo the first half of a table swap that was cut short."""
    old = f"{table}__old"
    if not spark.catalog.tableExists(table) and spark.catalog.tableExists(old):
        spark.sql(f"ALTER TABLE {quoted(old)} RENAME TO {_last_part(table)}")


def quoted(table: str) -> str:
    """A table name with every part in backticks; one that has backticks already is left alone."""
    return table if "`" in table else ".".join(f"`{part}`" for part in table.split("."))


def _last_part(table: str) -> str:
    return quoted(table).rsplit(".", 1)[-1]
