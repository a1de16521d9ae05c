"""Running a flow: read, keep what changed, transform, merge, write, then move the cursors."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.transforms import chain
from millrace.functions.workspace import Staged, stage
from millrace.operators.cdc import CdcConfig, CursorStore, apply_cdc, bounded_increment, upper_bounds
from millrace.operators.changelog import apply_change_log
from millrace.operators.merge import merge_into_table, upsert
from millrace.operators.scd2 import scd2_backdated, scd2_changes, scd2_init, scd2_merge, scd2_open
from millrace.plans.spec import BY_POSITION, FILE_TARGETS, FlowSpec, TargetSpec
from millrace.sinks import MERGE, merge_keys, write_plain
from millrace.sinks.deltas import apply_to_database, by_current_flag, load_type2_table
from millrace.sinks.files import replace_table, write_iceberg, write_jdbc
from millrace.sinks.snapshots import BUCKET, Buckets, Snapshot, SnapshotFolder, part_keys
from millrace.sources import read_source, read_target

# Noted in a listing: no key of a type 2 target has closed rows alone. True after a first load, kept by later ones.
_EVERY_KEY_OPEN = "every_key_open"


@dataclass(frozen=True)
class RunResult:
    """What a run did. ``frame`` is lazy: the target as it is now, or the rows that were written."""

    flow: str
    run_id: str
    as_of: Any
    frame: DataFrame
    cursors: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class _Mark:
    """The window a source is read in; its end is stored once the target is written."""

    state: str
    flow: str
    column: str
    mode: str
    cdc: CdcConfig
    last: str | None
    value: str | None


def transformed(spec: FlowSpec, rows: DataFrame) -> DataFrame:
    return chain(rows, [t.step() for t in spec.transforms])


def build_increment(spark: SparkSession, spec: FlowSpec) -> DataFrame:
    """The lazy rows a run would load, without writing or recording anything."""
    return _increment(spark, spec)[0]


def run_flow(spark: SparkSession, spec: FlowSpec, as_of: Any = None) -> RunResult:
    """Run ``spec`` once. The caller's session is used and left running.

    The target is written before the cursors: a run that dies in between is simply repeated, and
    upsert, SCD2 and change-log targets come out the same.
    """
    run_id = uuid.uuid4().hex
    as_of = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
    increment, marks = _increment(spark, spec)
    frame = load_increment(spark, spec, increment, as_of)
    for path in sorted({m.state for m in marks}):
        CursorStore(spark, path).put([(m.flow, m.column, m.mode, m.value)
                                      for m in marks if m.state == path], run_id)
    return RunResult(spec.name, run_id, as_of, frame,
                     {m.flow: m.value for m in marks if m.value is not None})


# -- reading -------------------------------------------------------------------------------------

def _increment(spark: SparkSession, spec: FlowSpec) -> tuple[DataFrame, list[_Mark]]:
    read = [read_source(spark, s.type, s.config) for s in spec.sources]
    marks = _windows(spark, spec, read)
    frames = [bounded_increment(df, mark.cdc, mark.last, mark.value) if mark else apply_cdc(df, source.cdc)
              for df, source, mark in zip(read, spec.sources, marks)]
    stack = DataFrame.union if spec.combine == BY_POSITION else DataFrame.unionByName
    return transformed(spec, reduce(stack, frames)), [m for m in marks if m]


def _windows(spark: SparkSession, spec: FlowSpec, read: list[DataFrame]) -> list[_Mark | None]:
    """Where the increment of each source starts and ends; None for sources without a stored cursor."""
    kept = {n: s.cdc.on_log(read[n].schema[s.cdc.seq].dataType) if s.cdc.mode == "binlog" else s.cdc
            for n, s in enumerate(spec.sources) if s.cdc.enabled and s.cdc.state}
    owner = {n: f"{spec.name}/{spec.sources[n].name}" for n in kept}
    last = {}
    for state in sorted({cdc.state for cdc in kept.values()}):
        mine = [n for n, cdc in kept.items() if cdc.state == state]
        known = CursorStore(spark, state).newest([owner[n] for n in mine])
        last.update({n: known.get((owner[n], kept[n].column)) for n in mine})
    tops = dict(zip(kept, upper_bounds([(read[n], cdc, last[n]) for n, cdc in kept.items()])))
    return [_Mark(kept[n].state, owner[n], kept[n].column, kept[n].mode, kept[n], last[n], tops[n])
            if n in kept else None for n in range(len(read))]


# -- writing -------------------------------------------------------------------------------------

def load_increment(spark: SparkSession, spec: FlowSpec, increment: DataFrame, as_of: Any) -> DataFrame:
    """Write or merge transformed rows into the target of ``spec``."""
    target = spec.target
    if not (target.scd2 or target.mode == MERGE or spec.change_log):
        return _write_as_is(spark, target, increment)
    limit = target.config.get("broadcast_bytes")
    staged = stage(increment, limit=None if limit is None else int(limit))
    try:
        if target.type in FILE_TARGETS:
            return _merge_folder(spark, spec, staged, as_of)
        if target.type == "iceberg":
            return _merge_iceberg(spark, spec, staged, as_of)
        return _merge_whole(spark, spec, staged, as_of)
    finally:
        staged.discard()


def _write_as_is(spark: SparkSession, target: TargetSpec, rows: DataFrame) -> DataFrame:
    if target.type in FILE_TARGETS:
        folder = SnapshotFolder(spark, target.config["path"])
        before = folder.snapshot()
        if before is not None:
            return _write_to_folder(folder, before, target, rows)
        if target.mode == "overwrite":
            # The old files, which the rows may come from, are gone by then.
            write_plain(rows, target.type, target.config)
            return read_target(spark, target.type, target.config)
    write_plain(rows, target.type, target.config)
    return rows


def _write_to_folder(folder: SnapshotFolder, before: Snapshot, target: TargetSpec,
                     rows: DataFrame) -> DataFrame:
    """Plain save modes on a folder that already holds committed loads."""
    if target.mode in ("error", "errorifexists", "default"):
        raise ValueError(f"{folder.path} already holds data")
    if target.mode == "ignore":
        return folder.read(at=before)
    if target.mode == "append":
        rows = rows.select(*[f"`{f.name}`" for f in before.schema.fields])
        after = folder.commit(rows, before.format, before.options, before.partition_by, replace=(),
                              at=before, buckets=before.buckets)
    else:
        after = folder.commit(rows, target.config["format"], target.config.get("options"),
                              target.partition_by, at=before)
    return folder.read(at=after)


def _merged(spec: FlowSpec, current: DataFrame | None, staged: Staged, as_of: Any) -> DataFrame:
    """The whole new contents of the target."""
    target, log, small = spec.target, spec.change_log, staged.small
    if log:
        if current is None:
            payload = [c for c in staged.frame.columns if c not in (log.op, log.seq)]
            current = staged.frame.select(*payload).limit(0)
        return apply_change_log(current, staged.frame, log.keys, log.seq, log.op, broadcast_log=small)
    if target.scd2:
        if current is None:
            return scd2_init(staged.frame, target.scd2, as_of)
        if target.scd2.backdated:
            return scd2_backdated(current, staged.frame, target.scd2, as_of, broadcast_source=small)
        # Such a target may have been written by anyone.
        return scd2_merge(current, staged.frame, target.scd2, as_of, broadcast_source=small, check_target=True)
    if current is None:
        current = staged.frame.limit(0)
    return upsert(current, staged.frame, merge_keys(target.config), broadcast_source=small,
                  order_by=target.config.get("order_by"), null_safe=bool(target.config.get("null_safe")),
                  repeated_target_keys=bool(target.config.get("repeated_target_keys")))


def _merge_folder(spark: SparkSession, spec: FlowSpec, staged: Staged, as_of: Any) -> DataFrame:
    """Merge into files, reading and rewriting as few folders as the layout allows."""
    target, scd2 = spec.target, spec.target.scd2
    folder = SnapshotFolder(spark, target.config["path"])
    layout = (*target.partition_by, scd2.is_current) if scd2 else tuple(target.partition_by)
    how = {"format": target.config["format"].lower(), "options": target.config.get("options"),
           "partition_by": layout, "rebalance_by": target.partition_by, "buckets": _buckets(spec)}
    before = folder.snapshot()
    if before is None or (before.format, before.partition_by, before.buckets) != (how["format"], layout, how["buckets"]):
        current = read_target(spark, target.type, target.config)
        rows = _merged(spec, current, staged, as_of)
        # What other writers than type 2 loads leave behind is not known: they may close or remove any row.
        notes = {_EVERY_KEY_OPEN: True} if scd2 and current is None else None
        return folder.read(at=folder.commit(rows, at=before, notes=notes, **how))

    reached = _reached_parts(spec, staged.frame, before)
    notes = None
    if scd2 and not scd2.backdated:
        open_parts = {p for p in reached if json.loads(p).get(scd2.is_current) == "true"}
        every_key_open = bool(before.notes.get(_EVERY_KEY_OPEN))
        rows = scd2_open(folder.read(open_parts, before), staged.frame, scd2, as_of,
                         broadcast_source=staged.small, check_target=True, every_key_open=every_key_open,
                         history=None if every_key_open else folder.read(reached - open_parts, before))
        reached = open_parts        # closed rows are only added to
        notes = {_EVERY_KEY_OPEN: every_key_open and not scd2.closes_absent}
    else:
        rows = _merged(spec, folder.read(reached, before), staged, as_of)
    return folder.read(at=folder.commit(rows, replace=reached, at=before, notes=notes, **how))


def _keys(spec: FlowSpec) -> list[str]:
    if spec.change_log:
        return list(spec.change_log.keys)
    return list(spec.target.scd2.keys) if spec.target.scd2 else list(merge_keys(spec.target.config))


def _buckets(spec: FlowSpec) -> Buckets | None:
    n = spec.target.config.get("buckets")
    return Buckets(tuple(_keys(spec)), int(n), bool(spec.target.config.get("null_safe"))) if n else None


def _reached_parts(spec: FlowSpec, increment: DataFrame, before: Snapshot) -> set[str]:
    """Partitions that may hold keys of the increment.

    Rows of one key share a bucket, and a partition only if the partition columns belong to the key; otherwise
    every partition may be meant. A full source also means the keys it lacks.
    """
    target, parts = spec.target, before.parts()
    if target.scd2 and target.scd2.closes_absent:
        return parts
    if before.buckets:
        known = before.buckets.reached(increment, before.schema)
        parts = {p for p in parts if json.loads(p).get(BUCKET) in known}
    columns = target.partition_by
    if not columns or not set(columns) <= set(_keys(spec)):
        return parts
    typed = increment.select(*[F.col(c).cast(before.schema[c].dataType).alias(c) for c in columns])
    wanted = [json.loads(p) for p in part_keys(typed, columns)]
    known = {tuple(w.get(c) for c in columns) for w in wanted}
    return {p for p in parts if tuple(json.loads(p).get(c) for c in columns) in known}


def _merge_iceberg(spark: SparkSession, spec: FlowSpec, staged: Staged, as_of: Any) -> DataFrame:
    """Formats with MERGE of their own get only the changed rows."""
    target, path = spec.target, spec.target.config["path"]
    if target.scd2:
        current = read_target(spark, "iceberg", target.config)
        if current is None:
            write_iceberg(scd2_init(staged.frame, target.scd2, as_of), path, "append")
        else:
            changes = scd2_changes(current, staged.frame, target.scd2, as_of,
                                   broadcast_source=staged.small, check_target=True)
            merge_into_table(changes, path, [*target.scd2.keys, target.scd2.version])
    elif spec.change_log:
        current = read_target(spark, "iceberg", target.config)
        write_iceberg(_merged(spec, current, staged, as_of), path, "overwrite")
    else:
        merge_into_table(staged.frame, path, merge_keys(target.config),
                         order_by=target.config.get("order_by"),
                         null_safe=bool(target.config.get("null_safe")))
    return read_target(spark, "iceberg", target.config)


def compact_target(spark: SparkSession, spec: FlowSpec) -> DataFrame | None:
    """Join the small files of a flow's file target; None if nothing has been committed there."""
    folder = SnapshotFolder(spark, spec.target.config["path"])
    before = folder.snapshot()
    return None if before is None else folder.read(at=folder.compact())


def _merge_whole(spark: SparkSession, spec: FlowSpec, staged: Staged, as_of: Any) -> DataFrame:
    """Catalog tables and databases: what changed where the target can take that, else everything anew."""
    target, scd2 = spec.target, spec.target.scd2
    current = read_target(spark, target.type, target.config)
    if target.type == "table":
        table = target.config["table"]
        if scd2 and not scd2.backdated and current is not None and by_current_flag(spark, table, scd2):
            load_type2_table(spark, table, staged, scd2, as_of)
            return spark.read.table(table)
        layout = (scd2.is_current, *target.partition_by) if scd2 and not scd2.backdated else target.partition_by
        replace_table(_merged(spec, current, staged, as_of), table, target.config.get("format") or "parquet",
                      target.config.get("options"), layout)
        return spark.read.table(table)
    if scd2 and not scd2.backdated and current is not None and target.config.get("apply") == "delta":
        changes = stage(scd2_changes(current, staged.frame, scd2, as_of, broadcast_source=staged.small, check_target=True), "changes")
        # The same load again takes the same staging table.
        run_id = uuid.uuid5(uuid.NAMESPACE_OID, f"{spec.name}/{as_of}").hex
        apply_to_database(spark, target.config, changes.frame, [*scd2.keys, scd2.version], run_id)
        changes.discard()
        return read_target(spark, target.type, target.config)
    rows = _merged(spec, current, staged, as_of)
    # Reading and overwriting one database table at once is not possible: rest in between.
    rows = stage(rows, "result").frame
    write_jdbc(rows, {"truncate": True, **target.config}, "overwrite")
    return rows
