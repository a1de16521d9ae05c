"""Reading relational databases through Spark's JDBC source."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.dialects import check_connection, connection_options, database_of

_BOUND_KEYS = ("partition_column", "lower_bound", "upper_bound", "num_partitions")


def check_jdbc_source(config: Mapping[str, Any], what: str = "jdbc source") -> None:
    check_connection(config, what)
    if bool(config.get("query")) == bool(config.get("table")):
        raise ValueError(f"{what} needs exactly one of 'query' and 'table'")
    if config.get("partition_column") and not config.get("num_partitions"):
        raise ValueError(f"{what}: 'partition_column' needs 'num_partitions'")
    if not config.get("partition_column") and any(config.get(k) is not None for k in _BOUND_KEYS):
        raise ValueError(f"{what}: partition bounds need 'partition_column'")
    if config.get("predicates") and config.get("partition_column"):
        raise ValueError(f"{what}: give 'predicates' or 'partition_column', not both")


def relation(config: Mapping[str, Any]) -> str:
    """What goes into ``dbtable``: the table, or the query as a subquery.

    Spark refuses its ``query`` option together with partitioning, a subquery allows both.
    """
    return config["table"] if config.get("table") else f"({_bare(config['query'])}) q"


def _bare(query: str) -> str:
    return query.strip().rstrip(";").rstrip()


def scan_options(config: Mapping[str, Any]) -> dict[str, str]:
    """All JDBC options of a scan that needs no look at the data (bounds already known)."""
    out = connection_options(config)
    if config.get("query") and not (config.get("partition_column") or config.get("predicates")):
        out["query"] = _bare(config["query"])
    else:
        out["dbtable"] = relation(config)
    if config.get("fetchsize"):
        out["fetchsize"] = str(config["fetchsize"])
    if config.get("partition_column"):
        out["partitionColumn"] = config["partition_column"]
        out["lowerBound"] = str(config["lower_bound"])
        out["upperBound"] = str(config["upper_bound"])
        out["numPartitions"] = str(config["num_partitions"])
    out.update({str(k): str(v) for k, v in dict(config.get("options") or {}).items()})
    return out


def bounds_query(config: Mapping[str, Any]) -> str:
    column = config["partition_column"]
    return f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {relation(config)}"


def _with_bounds(spark: SparkSession, config: Mapping[str, Any]) -> dict[str, Any]:
    """Ask the database for the bounds that the config leaves out (one aggregate row)."""
    known = dict(config)
    if known.get("lower_bound") is None or known.get("upper_bound") is None:
        row = (spark.read.format("jdbc").options(**connection_options(config))
               .option("query", bounds_query(config)).load().first())
        if row[0] is None:
            for key in _BOUND_KEYS:
                known.pop(key, None)
            return known
        known["lower_bound"] = row[0] if known.get("lower_bound") is None else known["lower_bound"]
        known["upper_bound"] = row[1] if known.get("upper_bound") is None else known["upper_bound"]
    return known


def read_jdbc(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    """Scan a table or query; filters and columns are pushed into it by Spark.

    ``partition_column`` with ``num_partitions`` splits the scan into ranges. Where ranges would be
    lopsided, ``predicates`` lists one WHERE clause per partition instead.
    """
    check_jdbc_source(config)
    if config.get("predicates"):
        options = scan_options(config)
        url, table = options.pop("url"), options.pop("dbtable")
        return spark.read.jdbc(url, table, predicates=list(config["predicates"]), properties=options)
    if config.get("partition_column"):
        config = _with_bounds(spark, config)
    return spark.read.format("jdbc").options(**scan_options(config)).load()


def exists_query(config: Mapping[str, Any]) -> str:
    """Standard catalog lookup, the same on all supported databases."""
    *schema, table = str(config["table"]).replace("`", "").replace('"', "").split(".")
    text = f"SELECT COUNT(*) AS n FROM information_schema.tables WHERE table_name = '{_quoted(table)}'"
    if schema:
        text += f" AND table_schema = '{_quoted(schema[-1])}'"
    elif not config.get("url") and str(config.get("db_type") or "mysql").lower() == "mysql":
        text += f" AND table_schema = '{_quoted(str(database_of(config)))}'"
    return text


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def jdbc_table_exists(spark: SparkSession, config: Mapping[str, Any]) -> bool:
    row = (spark.read.format("jdbc").options(**connection_options(config))
           .option("query", exists_query(config)).load().first())
    return row[0] > 0
