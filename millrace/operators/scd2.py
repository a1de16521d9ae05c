"""Type 2 slowly changing dimensions.

A target row is *open* (current flag true) or *closed*. A load compares the source with the open
rows only: a changed key gets its open row closed and a new version opened at the same moment, a new
key gets version 1, everything else stays as it is. Closed rows are never touched again.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.keys import (all_of, any_of, as_keys, has_order, keyed, one_row_per_key, require_columns,
                                     require_comparable)
from millrace.operators.cdc import time_literal

# The types a dimension's validity columns may get at the first load.
TIME_TYPES = {"timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
              "date": T.DateType()}

_CHANGED = "__changed"
_PIECE = "__piece"          # 0 = the row the target had, 1 = a version this load opens
_CLOSED_VERSION = "__closed_version"
_OPEN = "__open"
_OPEN_ROWS = "open rows of the scd2 target"


@dataclass(frozen=True)
class Scd2Config:
    """The ``scd2`` section of a target."""

    keys: tuple[str, ...]
    valid_from: str = "valid_from"
    valid_to: str = "valid_to"
    is_current: str = "is_current"
    version: str = "version"
    track: tuple[str, ...] | None = None
    order_by: Any = None
    time_type: str = "timestamp"
    deletes: str = "keep"               # "close": a source is a full snapshot, open rows it lacks are closed
    backdated: bool = False             # loads may be dated inside history
    confirmed: str = "confirmed_at"     # the column in which a backdated target keeps the later loads of a version

    def __post_init__(self):
        object.__setattr__(self, "keys", tuple(as_keys(self.keys)))
        if self.track is not None:
            object.__setattr__(self, "track", tuple(as_keys(self.track)))
        if self.time_type not in TIME_TYPES:
            raise ValueError(f"time_type {self.time_type!r} is not one of {sorted(TIME_TYPES)}")
        if self.deletes not in ("keep", "close"):
            raise ValueError(f"deletes must be 'keep' or 'close', not {self.deletes!r}")
        if self.backdated and self.deletes == "close":
            raise ValueError("backdated loads name the keys they change; they close no others")

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any] | None) -> Scd2Config | None:
        """None when the section is absent or not enabled."""
        raw = dict(raw or {})
        if not raw.get("enabled", False):
            return None
        # Fixed names: how a specification spells these settings.
        return cls(
            keys=raw.get("key_columns") or (),
            valid_from=raw.get("effective_date_column", "valid_from"),
            valid_to=raw.get("end_date_column", "valid_to"),
            is_current=raw.get("current_flag_column", "is_current"),
            version=raw.get("version_column", "version"),
            track=raw.get("track"),
            order_by=raw.get("order_by"),
            time_type=raw.get("time_type", "timestamp"),
            deletes=str(raw.get("deletes") or "keep"),
            backdated=bool(raw.get("backdated", False)),
            confirmed=raw.get("confirmed_column", "confirmed_at"),
        )

    @property
    def closes_absent(self) -> bool:
        return self.deletes == "close"

    @property
    def own_columns(self) -> tuple[str, ...]:
        own = (self.valid_from, self.valid_to, self.is_current, self.version)
        return (*own, self.confirmed) if self.backdated else own


def current_rows(dimension: DataFrame, config: Scd2Config) -> DataFrame:
    """Open rows. The bare flag reaches the scan: partition pruning, or a Parquet filter."""
    return dimension.filter(F.col(config.is_current))


def closed_rows(dimension: DataFrame, config: Scd2Config) -> DataFrame:
    flag = F.col(config.is_current)
    return dimension.filter((flag == F.lit(False)) | flag.isNull())


def scd2_init(source: DataFrame, config: Scd2Config, as_of: Any) -> DataFrame:
    """A first load: every source row as open version 1, valid from ``as_of``."""
    require_columns(source, config.keys, "scd2 source")
    names = [c for c in source.columns if c not in config.own_columns]
    stamp = TIME_TYPES[config.time_type]
    unique = one_row_per_key(source.filter(keyed(config.keys)), config.keys, config.order_by, "scd2 source")
    confirmed = [F.array().cast(T.ArrayType(stamp)).alias(config.confirmed)] if config.backdated else []
    return unique.unionByName(source.filter(~keyed(config.keys))).select(
        *names,
        time_literal(as_of, stamp).alias(config.valid_from),
        F.lit(None).cast(stamp).alias(config.valid_to),
        F.lit(True).alias(config.is_current),
        F.lit(1).alias(config.version),
        *confirmed)


class _Load:
    """The expressions of one load, for a target aliased ``t`` and a source aliased ``s``."""

    def __init__(self, target: DataFrame, source: DataFrame, config: Scd2Config, as_of: Any):
        require_columns(target, [*config.keys, *config.own_columns], "scd2 target")
        require_columns(source, config.keys, "scd2 source")
        flag = target.schema[config.is_current].dataType
        if not isinstance(flag, T.BooleanType):
            raise ValueError(f"column {config.is_current!r} must be boolean, not {flag.simpleString()}; "
                             "give a schema when it is a partition column")
        self.config = config
        self.schema = target.schema
        self.shared = [c for c in target.columns if c in source.columns
                       and c not in config.keys and c not in config.own_columns]
        tracked = list(config.track) if config.track is not None else self.shared
        require_columns(source, tracked, "scd2 source")
        require_columns(target, tracked, "scd2 target")
        require_comparable(target, [*config.keys, *tracked], "key or tracked column")
        self.as_of = time_literal(as_of, self.schema[config.valid_from].dataType)
        key = config.keys[0]
        self.in_target = F.col(f"t.{key}").isNotNull()
        self.in_source = F.col(f"s.{key}").isNotNull()
        differs = [~F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in tracked]
        differ = self.in_target & self.in_source & (any_of(differs) if differs else F.lit(False))
        self.gone = self.in_target & ~self.in_source if config.closes_absent else F.lit(False)
        # A version may only be closed after it was opened; intervals must not be empty or run backwards.
        opened = F.col(f"t.{config.valid_from}")
        late = F.raise_error(F.concat(F.lit("as_of is not after the start of an open version that changes: "),
                                      self.as_of.cast("string"), F.lit(" <= "), opened.cast("string"))).cast("boolean")
        ends = differ | self.gone
        self.changed = F.when(~ends, F.lit(False)).when(opened >= self.as_of, late).otherwise(F.lit(True))

    def source_columns(self, source: DataFrame) -> list[Column]:
        """Keys and shared attributes in the target's types; columns the target lacks are left out."""
        return [F.col(c).cast(self.schema[c].dataType).alias(c)
                for c in [*self.config.keys, *self.shared]]

    def same_key(self) -> Column:
        return all_of([F.col(f"t.{k}") == F.col(f"s.{k}") for k in self.config.keys])

    def output(self, old_version: Column, is_changed: Column, opened: Column) -> list[Column]:
        """The target's columns: the old row (perhaps now closed), or the version just opened."""
        c = self.config
        out = []
        for field in self.schema.fields:
            name, dtype = field.name, field.dataType
            old = F.col(f"t.{name}")
            if name in c.keys:
                value = F.coalesce(old, F.col(f"s.{name}"))
            elif name == c.valid_from:
                value = F.when(opened, self.as_of).otherwise(old)
            elif name == c.valid_to:
                value = F.when(opened, F.lit(None)).when(is_changed, self.as_of).otherwise(old)
            elif name == c.is_current:
                value = F.when(opened, F.lit(True)).when(is_changed, F.lit(False)).otherwise(old)
            elif name == c.version:
                value = F.when(opened, old_version + 1).otherwise(old)
            elif name in self.shared:
                value = F.when(opened, F.col(f"s.{name}")).otherwise(old)
            else:
                value = old
            out.append(value.cast(dtype).alias(name))
        return out

    def opened_rows(self, source: DataFrame, closed_version: Column) -> DataFrame:
        """Source rows whose key has no open row, as new versions."""
        c = self.config
        out = []
        for field in self.schema.fields:
            if field.name in c.keys or field.name in self.shared:
                value = F.col(field.name)
            elif field.name == c.valid_from:
                value = self.as_of
            elif field.name == c.is_current:
                value = F.lit(True)
            elif field.name == c.version:
                value = F.coalesce(closed_version, F.lit(0)) + 1
            else:
                value = F.lit(None)
            out.append(value.cast(field.dataType).alias(field.name))
        return source.select(*out)


def _pieces(load: _Load, joined: DataFrame, old_version: Column) -> DataFrame:
    """One output row per kept, closed or opened version of a joined pair."""
    count = (F.when(~load.in_target, F.array(F.lit(1)))
              .when(F.col(_CHANGED) & load.in_source, F.array(F.lit(0), F.lit(1)))
              .otherwise(F.array(F.lit(0))))
    return (joined.withColumn(_CHANGED, load.changed)
                  .withColumn(_PIECE, F.explode(count))
                  .select(*load.output(old_version, F.col(_CHANGED), F.col(_PIECE) == 1)))


def _refresh(target: DataFrame, source: DataFrame, config: Scd2Config, as_of: Any, *,
             broadcast_source: bool, only_changes: bool, history: DataFrame | None,
             check_target: bool = False) -> DataFrame:
    """Open rows of ``target`` after the load, together with the rows the load closed.

    ``history`` holds the closed rows that may number a key on; None if every key has an open row.
    """
    load = _Load(target, source, config, as_of)
    keys = list(config.keys)
    open_rows = current_rows(target, config)
    matchable = open_rows.filter(keyed(keys))

    extra = [c for c in source.columns if c not in (*keys, *load.shared)]
    extra = extra if has_order(config.order_by) else []
    prepared = source.select(*load.source_columns(source), *extra)
    unique = one_row_per_key(prepared.filter(keyed(keys)), keys, config.order_by,
                             "scd2 source").select(*keys, *load.shared)
    keyless = load.opened_rows(prepared.filter(~keyed(keys)).select(*keys, *load.shared), F.lit(0))

    if broadcast_source:
        # The source is small: no row of the dimension is shuffled. It is read once in full, and its
        # keys and versions once more to see which source keys have no open row.
        pairs = matchable.alias("t").join(F.broadcast(unique.alias("s")), load.same_key(),
                                          "inner" if only_changes and not config.closes_absent else "left")
        if only_changes:
            pairs = pairs.filter(load.changed)
        versions = _pieces(load, pairs, F.coalesce(F.col(f"t.{config.version}"), F.lit(0)))
        wanted = prepared.filter(keyed(keys)).select(*keys).distinct()
        known = [*keys, config.is_current, config.version]
        past = open_rows.select(*known)
        if history is not None:
            past = past.unionByName(closed_rows(history, config).select(*known))
        seen = (past.join(F.broadcast(wanted), keys, "left_semi")
                .groupBy(*keys).agg(F.count_if(config.is_current).alias(_OPEN),
                                    F.max(config.version).alias(_CLOSED_VERSION)))
        added = unique.join(seen, keys, "left").filter(
            F.when(F.coalesce(F.col(_OPEN), F.lit(0)) <= 1, F.coalesce(F.col(_OPEN), F.lit(0)) == 0)
             .otherwise(F.raise_error(F.lit(f"repeated key in {_OPEN_ROWS}")).cast("boolean")))
        result = versions.unionByName(load.opened_rows(added, F.col(_CLOSED_VERSION)))
    else:
        # Both sides are hashed and sorted on the key once. Keys are unique on either side, so no key
        # weighs more than one row; closed versions are reduced to one number per key before they move.
        if history is None:
            known = unique.withColumn(_CLOSED_VERSION, F.lit(0))
        else:
            before = (closed_rows(history, config).filter(keyed(keys))
                      .groupBy(*keys).agg(F.max(config.version).alias(_CLOSED_VERSION)))
            known = unique.join(before, keys, "left")
        if check_target:
            matchable = matchable.withColumn(_OPEN, F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
        pairs = matchable.alias("t").join(known.alias("s"), load.same_key(), "full_outer")
        if check_target:
            # As in the other branch, only keys that are loaded matter.
            pairs = pairs.filter(F.when(load.in_source & (F.col(f"t.{_OPEN}") > 1),
                                        F.raise_error(F.lit(f"repeated key in {_OPEN_ROWS}")).cast("boolean"))
                                 .otherwise(F.lit(True)))
        if only_changes:
            pairs = pairs.filter((load.in_source & ~load.in_target) | load.changed)
        old_version = F.coalesce(F.when(load.in_target, F.coalesce(F.col(f"t.{config.version}"), F.lit(0)))
                                 .otherwise(F.col(f"s.{_CLOSED_VERSION}")), F.lit(0))
        result = _pieces(load, pairs, old_version)

    result = result.unionByName(keyless)
    return result if only_changes else result.unionByName(open_rows.filter(~keyed(keys)))


def scd2_open(target: DataFrame, source: DataFrame, config: Scd2Config, as_of: Any, *,
              broadcast_source: bool = False, history: DataFrame | None = None,
              every_key_open: bool = False, check_target: bool = False) -> DataFrame:
    """What replaces the target's open rows: open rows after the load, and the rows it closed.

    Closed rows of earlier loads are not in it. ``history`` names where to look for them when
    ``target`` holds open rows only. With ``every_key_open`` - which loads keep so - no key has closed
    rows alone, and closed rows are not read at all.
    """
    history = None if every_key_open else target if history is None else history
    return _refresh(target, source, config, as_of, broadcast_source=broadcast_source,
                    only_changes=False, history=history, check_target=check_target)


def scd2_changes(target: DataFrame, source: DataFrame, config: Scd2Config, as_of: Any, *,
                 broadcast_source: bool = False, check_target: bool = False) -> DataFrame:
    """Only the rows the load closes or opens: what a MERGE on key and version would write."""
    return _refresh(target, source, config, as_of, broadcast_source=broadcast_source,
                    only_changes=True, history=target, check_target=check_target)


def scd2_merge(target: DataFrame, source: DataFrame, config: Scd2Config, as_of: Any, *,
               broadcast_source: bool = False, check_target: bool = False) -> DataFrame:
    """The whole dimension after loading ``source`` at ``as_of``.

    Tracked are the columns both sides share, apart from the keys and the four dimension columns, or
    ``config.track``. Columns only the source has are dropped; columns only the target has keep
    their value on a new version. A key that has only closed rows continues their numbering.

    A key must have one open row at most, which loads keep so. ``check_target`` makes the query fail
    where a target from elsewhere breaks this for a loaded key (with ``broadcast_source`` that is always
    checked). ``as_of`` must lie after the start of every version that the load closes.
    """
    return (scd2_open(target, source, config, as_of, broadcast_source=broadcast_source,
                      check_target=check_target)
            .unionByName(closed_rows(target, config)))


def scd2_backdated(target: DataFrame, source: DataFrame, config: Scd2Config, as_of: Any, *, broadcast_source: bool = False) -> DataFrame:
    """The whole dimension after loading ``source``, which may be dated inside history.

    Loads in any order give what loads in the order of their dates give. A state dated inside a version cuts it: the version
    ends there, the new one lasts until the next date at which something was loaded for the key, and later versions are renumbered. For
    that, versions keep the dates of later loads that found them unchanged (``config.confirmed``): a cut before such a date leaves the rest as a
    version of its own. Without these dates a load that changed nothing would leave no trace.

    Only keys of the source are worked on; a key's versions, one per load at most, meet in one window. Rows without a key are kept, or added as they
    are by :func:`scd2_init`. Two different states of one key and date fail; the same one again changes nothing. Where a version ends and
    none begins, nothing is opened. Columns the target lacks are dropped; columns the source lacks take the values of the version before. Where ``track``
    leaves columns out, a version that is cut keeps their first values.
    """
    load = _Load(target, source, config, as_of)
    keys, c = list(config.keys), config
    tracked = list(config.track) if config.track is not None else load.shared
    require_columns(target, [c.confirmed], "backdated scd2 target")
    stamp = target.schema[c.valid_from].dataType
    attributes = [f for f in target.schema.fields if f.name not in (*keys, *c.own_columns)]
    extra = [x for x in source.columns if x not in (*keys, *load.shared)] if has_order(config.order_by) else []
    prepared = source.select(*load.source_columns(source), *extra)
    unique = one_row_per_key(prepared.filter(keyed(keys)), keys, config.order_by, "scd2 source").select(*keys, *load.shared)

    mine = F.broadcast(unique.select(*keys)) if broadcast_source else unique.select(*keys)
    reached = target.filter(keyed(keys)).join(mine, keys, "left_semi")
    others = target.filter(keyed(keys)).join(mine, keys, "left_anti").unionByName(target.filter(~keyed(keys)))

    def state(carries: bool) -> Column:
        return F.struct(*[(F.col(f.name).cast(f.dataType) if f.name in load.shared or not carries else F.lit(None).cast(f.dataType)).alias(f.name)
                          for f in attributes])

    at, gone, new, values = "__at", "__gone", "__new", "__values"
    versions = Window.partitionBy(*keys).orderBy(c.valid_from)
    ends = F.col(c.valid_to).isNotNull() & ~F.col(c.valid_to).eqNullSafe(F.lead(c.valid_from).over(versions))
    dated = F.array_union(F.array(c.valid_from), F.coalesce(c.confirmed, F.array().cast(T.ArrayType(stamp))))
    past = reached.withColumn("__ends", ends)
    seen = past.select(*keys, F.explode(dated).alias(at), F.lit(False).alias(gone), F.lit(False).alias(new), state(False).alias(values))
    ended = past.filter("__ends").select(*keys, F.col(c.valid_to).alias(at), F.lit(True).alias(gone), F.lit(False).alias(new), state(False).alias(values))
    now = unique.select(*keys, load.as_of.alias(at), F.lit(False).alias(gone), F.lit(True).alias(new), state(True).alias(values))

    # Everything that was ever loaded for these keys, in order. A state that is loaded again takes no second place.
    in_order = Window.partitionBy(*keys).orderBy(at, F.desc(gone), new)
    same = all_of([F.col(f"{values}.{x}").eqNullSafe(F.col(f"__before.{x}")) for x in tracked]) if tracked else F.lit(True)
    conflict = F.raise_error(F.concat(F.lit("two states of one key at "), F.col(at).cast("string"))).cast("boolean")
    twice = F.col("__before_at").eqNullSafe(F.col(at)) & ~F.col("__before_gone")
    own = [f.name for f in attributes if f.name not in load.shared]
    carried = [F.last(F.when(~F.col(new), F.struct(F.col(f"{values}.{x}").alias("v"))), ignorenulls=True).over(in_order)["v"].alias(x) for x in own]
    filled = F.struct(*[carried[own.index(f.name)] if f.name in own else F.col(f"{values}.{f.name}").alias(f.name) for f in attributes])
    events = (seen.unionByName(ended).unionByName(now).withColumn(values, filled)
              .withColumn("__before", F.lag(values).over(in_order)).withColumn("__before_at", F.lag(at).over(in_order))
              .withColumn("__before_gone", F.coalesce(F.lag(gone).over(in_order), F.lit(True)))
              .filter(F.when(F.col(new) & twice & ~same, conflict).otherwise(~(F.col(new) & twice)))
              # A version that begins where another one ends is no end.
              .withColumn("__opens", F.when(F.col(gone), F.lit(True)).otherwise(F.col("__before_gone") | ~same)))
    # An end dated like the load itself gives way to it.
    events = events.withColumn("__next_at", F.lead(at).over(in_order)).filter(~(F.col(gone) & F.col("__next_at").eqNullSafe(F.col(at))))
    numbered = events.withColumn("__group", F.sum(F.col("__opens").cast("int")).over(in_order))
    group = numbered.groupBy(*keys, "__group").agg(F.min(at).alias(c.valid_from), F.bool_or(gone).alias(gone), F.min_by(values, F.struct(at, new)).alias(values),
                                                   F.array_sort(F.collect_set(at)).alias("__dates"))
    by_start = Window.partitionBy(*keys).orderBy("__group")
    closed = group.withColumn(c.valid_to, F.lead(c.valid_from).over(by_start)).filter(~F.col(gone))
    closed = closed.withColumn(c.version, F.row_number().over(by_start)).withColumn(c.is_current, F.col(c.valid_to).isNull())
    closed = closed.withColumn(c.confirmed, F.slice("__dates", 2, F.greatest(F.size("__dates") - 1, F.lit(0))))
    rebuilt = closed.select(*[(F.col(f"{values}.{f.name}") if f.name not in (*keys, *c.own_columns) else F.col(f.name)).cast(f.dataType).alias(f.name)
                              for f in target.schema.fields])
    keyless = scd2_init(prepared.filter(~keyed(keys)).select(*keys, *load.shared), config, as_of)
    keyless = keyless.select(*[(F.col(f.name) if f.name in keyless.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema.fields])
    return others.unionByName(rebuilt).unionByName(keyless)
