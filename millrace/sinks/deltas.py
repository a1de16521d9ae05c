"""Type 2 loads that send a target what changed: catalog tables by partition, databases by statements.

A catalog table laid out by its current flag gets the rows a load closes appended, then its open partition replaced. A
database gets the changed rows in a staging table, and one transaction that updates and inserts by key and version. Both can be
repeated after a failure at any point: rows are told by key and version, and what is there already is not written again.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import keyed
from millrace.functions.workspace import Staged, stage
from millrace.operators.scd2 import Scd2Config, closed_rows, scd2_open
from millrace.sinks.files import quoted, write_jdbc
from millrace.sources.dialects import connection_options, db_type_of

# -- catalog tables ------------------------------------------------------------------------------


def by_current_flag(spark: SparkSession, table: str, config: Scd2Config) -> bool:
    """Whether the table's first partition column is its current flag."""
    columns = spark.catalog.listColumns(table)
    parts = [c.name for c in columns if c.isPartition]
    return parts[:1] == [config.is_current]


def load_type2_table(spark: SparkSession, table: str, source: Staged, config: Scd2Config, as_of: Any) -> None:
    """A type 2 load that rewrites the table's open rows only. Closed history is read for keys and versions, and added to."""
    current = spark.table(table)
    work = stage(scd2_open(current, source.frame, config, as_of, broadcast_source=source.small, check_target=True), "type2")
    view = f"type2_{uuid.uuid4().hex}"
    try:
        # A load that died between its two writes has left closed rows whose versions are still open.
        key = [*config.keys, config.version]
        closed = closed_rows(work.frame, config)
        known = closed_rows(current, config).select(*key)
        added = closed.filter(keyed(config.keys)).join(known, key, "left_anti").unionByName(closed.filter(~keyed(config.keys)))
        added = stage(added.select(*current.columns), "type2-closed")
        try:
            if added.rows:
                added.frame.write.mode("append").insertInto(quoted(table))
        finally:
            added.discard()
        parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition and c.name != config.is_current]
        plain = [c for c in current.columns if c not in (*parts, config.is_current)]
        work.frame.filter(F.col(config.is_current)).select(*plain, *parts).createOrReplaceTempView(view)
        spec = ", ".join([f"`{config.is_current}` = true", *(f"`{p}`" for p in parts)])
        spark.sql(f"INSERT OVERWRITE TABLE {quoted(table)} PARTITION ({spec}) SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)
        work.discard()


# -- databases -----------------------------------------------------------------------------------

# How the databases quote names.
_QUOTES = {"mysql": "``", "postgresql": '""', "mssql": "[]"}


def _name(db_type: str, name: str) -> str:
    left, right = _QUOTES[db_type]
    return ".".join(left + part.replace(right, right * 2) + right for part in name.split("."))


def delta_statements(db_type: str, table: str, staging: str, columns: Sequence[str], keys: Sequence[str]) -> list[str]:
    """Statements that bring the rows of ``staging`` into ``table``: update those whose ``keys`` are there, insert the others.

    Keys that hold NULL equal nothing: such rows are inserted unless an equal row is there. Run them in one transaction.
    """
    if db_type not in _QUOTES:
        raise ValueError(f"db_type {db_type!r} is not one of {sorted(_QUOTES)}")
    t, s = _name(db_type, table), _name(db_type, staging)
    cols = [_name(db_type, c) for c in columns]
    same = " AND ".join(f"t.{_name(db_type, k)} = s.{_name(db_type, k)}" for k in keys)
    alike = " AND ".join(f"(t.{c} = s.{c} OR (t.{c} IS NULL AND s.{c} IS NULL))" for c in cols)
    values = [c for c, n in zip(cols, columns) if n not in keys]
    update = {
        "mysql": f"UPDATE {t} t JOIN {s} s ON {same} SET " + ", ".join(f"t.{c} = s.{c}" for c in values),
        "postgresql": f"UPDATE {t} AS t SET " + ", ".join(f"{c} = s.{c}" for c in values) + f" FROM {s} AS s WHERE {same}",
        "mssql": "UPDATE t SET " + ", ".join(f"{c} = s.{c}" for c in values) + f" FROM {t} AS t JOIN {s} AS s ON {same}",
    }[db_type]
    listed = ", ".join(cols)
    there = f"SELECT 1 FROM {t} t WHERE ({same}) OR ({alike})"
    insert = f"INSERT INTO {t} ({listed}) SELECT {', '.join('s.' + c for c in cols)} FROM {s} s WHERE NOT EXISTS ({there})"
    return ([update] if values else []) + [insert]


def staging_name(table: str, run_id: str) -> str:
    """One staging table per run: a run that is repeated overwrites its own."""
    return f"{table}__delta_{run_id[:12]}"


def apply_to_database(spark: SparkSession, config: Mapping[str, Any], changes: DataFrame, keys: Sequence[str], run_id: str) -> None:
    """Write ``changes`` to a staging table from all tasks, then bring them in by one transaction on one connection."""
    db_type = db_type_of(config)
    staging = staging_name(str(config["table"]), run_id)
    write_jdbc(changes, {**config, "table": staging, "truncate": False}, "overwrite")
    options = connection_options(config)
    jvm = spark.sparkContext._jvm
    jvm.java.lang.Class.forName(options["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    connection = jvm.java.sql.DriverManager.getConnection(options["url"], options.get("user"), options.get("password"))
    run_in_transaction(connection, delta_statements(db_type, str(config["table"]), staging, changes.columns, keys), f"DROP TABLE {_name(db_type, staging)}")


def run_in_transaction(connection: Any, statements: Sequence[str], after: str) -> None:
    """All statements or none; ``after`` follows on its own, as dropping a table ends a transaction in some databases."""
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        try:
            for text in statements:
                statement.executeUpdate(text)
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        statement.executeUpdate(after)
        connection.commit()
    finally:
        connection.close()
