"""Declarative incremental loads on Spark: sources, CDC, transforms, upsert, SCD2, versions."""

from millrace.functions.keys import latest_per_key
from millrace.functions.sqltext import split_sql
from millrace.functions.transforms import not_null, register_transform, sql_block
from millrace.operators.cdc import (CdcConfig, CursorStore, apply_cdc, high_water_mark, since_sequence,
                                    since_timestamp)
from millrace.operators.changelog import apply_change_log, net_changes
from millrace.operators.merge import merge_into_table, upsert
from millrace.operators.scd2 import (Scd2Config, closed_rows, current_rows, scd2_backdated,
                                     scd2_changes, scd2_init, scd2_merge)
from millrace.operators.timejoins import asof_join, band_join, interval_join
from millrace.operators.versions import (append_if_changed, at_version, changed_versions, latest,
                                         version_history)
from millrace.sinks.snapshots import SnapshotFolder, staged_overwrite

__all__ = [
    "CdcConfig", "CursorStore", "Scd2Config", "SnapshotFolder", "append_if_changed", "apply_cdc",
    "apply_change_log", "asof_join", "at_version", "band_join", "changed_versions", "closed_rows", "current_rows",
    "high_water_mark", "interval_join", "latest", "latest_per_key", "merge_into_table", "net_changes", "not_null",
    "register_transform", "scd2_backdated", "scd2_changes", "scd2_init", "scd2_merge",
    "since_sequence", "since_timestamp", "split_sql", "sql_block", "staged_overwrite", "upsert",
    "version_history",
]
