"""Targets by type name."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from millrace.sinks.files import (MERGE, SAVE_MODES, check_jdbc_target, mode_of, write_files,
                                  write_iceberg, write_jdbc, write_table)
from millrace.sources.files import check_files

Config = Mapping[str, Any]

# Target types; the last two are "files" with the format already given.
TARGETS = ("iceberg", "jdbc", "s3", "files", "table", "csv", "parquet")
_ICEBERG_MODES = ("append", "overwrite", MERGE)


def target_type(name: Any) -> str:
    kind = str(name or "").lower()
    if kind not in TARGETS:
        raise ValueError(f"target type {name!r} is not one of {sorted(TARGETS)}")
    return kind


def target_config(kind: str, config: Config) -> dict[str, Any]:
    return {**config, "format": kind} if kind in ("csv", "parquet") else dict(config)


def merge_keys(config: Config) -> list[str]:
    keys = config.get("merge_keys") or []
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not keys:
        raise ValueError("mode 'merge' needs 'merge_keys'")
    return keys


def check_target(kind: str, config: Config) -> None:
    kind = target_type(kind)
    config = target_config(kind, config)
    if kind == "jdbc":
        check_jdbc_target(config)
        return
    if kind == "iceberg":
        if not config.get("path"):
            raise ValueError("iceberg target needs a 'path'")
        mode = mode_of(config, "iceberg target", _ICEBERG_MODES)
    elif kind == "table":
        if not config.get("table"):
            raise ValueError("table target needs a 'table'")
        mode = mode_of(config, "table target", (*SAVE_MODES, MERGE))
    else:
        check_files(config, "file target")
        mode = mode_of(config, "file target", (*SAVE_MODES, MERGE))
    if mode == MERGE:
        merge_keys(config)


def write_plain(df: DataFrame, kind: str, config: Config) -> None:
    """Append, overwrite, ignore or fail, as Spark's own writer does it."""
    mode = mode_of(config, f"{kind} target")
    if kind == "jdbc":
        write_jdbc(df, config, mode)
    elif kind == "iceberg":
        write_iceberg(df, config["path"], mode, config.get("options"))
    elif kind == "table":
        write_table(df, config["table"], mode, config.get("format") or "parquet",
                    config.get("options"), config.get("partition_by") or ())
    else:
        write_files(df, config["path"], config["format"], mode, config.get("options"),
                    config.get("partition_by") or ())
