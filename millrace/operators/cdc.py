"""Taking only what changed since the last load, and remembering how far we got."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime, timezone
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.keys import require_columns
from millrace.functions.workspace import literal_rows
from millrace.sources.files import path_is_missing

# The modes and their default columns.
MODES = ("timestamp", "sequence", "binlog")
DEFAULT_MODE = "timestamp"
DEFAULT_COLUMNS = {"timestamp": "updated_at", "sequence": "sequence_number"}

_TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType)


def time_literal(value: Any, dtype: T.DataType) -> Column:
    """A point in time as a literal of the column's type, so the filter reaches the scan.

    The detour over text keeps the driver's own time zone out of it.
    """
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc)
            text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
            text += "" if isinstance(dtype, T.TimestampNTZType) else "+00:00"
        else:
            text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, date):
        text = value.isoformat()
    else:
        text = str(value)
    if isinstance(dtype, T.StringType):
        return F.lit(text)
    if isinstance(dtype, T.DateType):
        text = text[:10]
    return F.lit(text).cast(dtype)


def _cursor_type(df: DataFrame, column: str, mode: str) -> T.DataType:
    require_columns(df, [column], "cdc input")
    dtype = df.schema[column].dataType
    fits = isinstance(dtype, _TIME_TYPES if mode == "timestamp" else T.NumericType)
    if not fits:
        raise ValueError(f"column {column!r} is {dtype.simpleString()}, not usable as a {mode} cursor")
    return dtype


def _with_nulls(condition: Column, column: str, nulls: str) -> Column:
    if nulls == "drop":
        return condition
    if nulls == "keep":
        return condition | F.col(column).isNull()
    raise ValueError(f"nulls must be 'drop' or 'keep', not {nulls!r}")


def since_timestamp(df: DataFrame, column: str = DEFAULT_COLUMNS["timestamp"],
                    last: Any = None, *, inclusive: bool = True, until: Any = None,
                    nulls: str = "drop", lookback: str | None = None) -> DataFrame:
    """Rows at or after ``last`` (after it with ``inclusive=False``), up to ``until`` if given.

    ``None`` means a first run, which takes every moment, however long ago.
    ``lookback`` (such as ``"2 hours"``) reads a margin again, for rows that arrive late.
    """
    dtype = _cursor_type(df, column, "timestamp")
    low = None if last is None else time_literal(last, dtype)
    if lookback:
        if not isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            raise ValueError(f"lookback needs a timestamp column, {column!r} is {dtype.simpleString()}")
        low = None if low is None else low - F.expr(f"INTERVAL {lookback}")
    col = F.col(column)
    if low is None:
        condition = col.isNotNull()
    else:
        condition = col >= low if inclusive or lookback else col > low
    if until is not None:
        condition = condition & (col <= time_literal(until, dtype))
    return df.filter(_with_nulls(condition, column, nulls))


def since_sequence(df: DataFrame, column: str = DEFAULT_COLUMNS["sequence"], last: Any = None, *,
                   until: Any = None, nulls: str = "drop") -> DataFrame:
    """Rows numbered above ``last``; ``None`` means a first run, which takes every number."""
    dtype = _cursor_type(df, column, "sequence")
    col = F.col(column)
    condition = col.isNotNull() if last is None else col > F.lit(str(last)).cast(dtype)
    if until is not None:
        condition = condition & (col <= F.lit(str(until)).cast(dtype))
    return df.filter(_with_nulls(condition, column, nulls))


def high_water_mark(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Largest cursor value, overall or per group, as column ``high_water_mark``."""
    return df.groupBy(*(by or [])).agg(F.max(column).alias("high_water_mark"))


@dataclass(frozen=True)
class CdcConfig:
    """The ``cdc`` section of a source."""

    enabled: bool = False
    mode: str = DEFAULT_MODE
    column: str | None = None
    inclusive: bool = True
    nulls: str = "drop"
    lookback: str | None = None
    initial: Any = None
    state: str | None = None
    keys: tuple[str, ...] = ()
    op: str = "op"
    seq: str = "seq"

    def on_log(self, dtype: T.DataType) -> CdcConfig:
        """The window over a change log's order column: above the last applied entry, up to the newest there is."""
        mode = "timestamp" if isinstance(dtype, _TIME_TYPES) else "sequence"
        return replace(self, mode=mode, column=self.seq, inclusive=False, lookback=None)

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any] | None) -> CdcConfig:
        raw = dict(raw or {})
        enabled = bool(raw.get("enabled", False))
        mode = str(raw.get("mode") or DEFAULT_MODE).lower()
        if enabled and mode not in MODES:
            raise ValueError(f"cdc mode {mode!r} is not one of {MODES}")
        section = dict(raw.get(mode) or {})
        keys = section.get("keys") or ()
        return cls(
            enabled=enabled,
            mode=mode,
            column=section.get("column", DEFAULT_COLUMNS.get(mode)),
            inclusive=bool(raw.get("inclusive", True)),
            nulls=raw.get("nulls", "drop"),
            lookback=raw.get("lookback"),
            initial=raw.get("initial"),
            state=raw.get("state"),
            keys=(keys,) if isinstance(keys, str) else tuple(keys),
            op=section.get("op", "op"),
            seq=section.get("seq", "seq"),
        )


def apply_cdc(df: DataFrame, config: CdcConfig, last: Any = None, until: Any = None) -> DataFrame:
    """The increment of ``df``; ``last`` overrides the configured start, and without either it is everything.

    A change log (mode ``binlog``) is itself the increment: it passes unchanged and is applied to
    the target by ``apply_change_log``.
    """
    if not config.enabled or config.mode == "binlog":
        return df
    start = config.initial if last is None else last
    if config.mode == "timestamp":
        return since_timestamp(df, config.column, start, inclusive=config.inclusive, until=until,
                               nulls=config.nulls, lookback=config.lookback)
    return since_sequence(df, config.column, start, until=until, nulls=config.nulls)


class CursorStore:
    """How far each flow has read: one appended row per load, in a Parquet folder.

    The newest row of a flow and column counts. Write it only after the target was written.
    """

    SCHEMA = ("flow STRING, cursor_column STRING, cursor_type STRING, cursor_value STRING, "
              "run_id STRING, recorded_at TIMESTAMP_NTZ")

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if path_is_missing(error):
                return literal_rows(self.spark, [], self.SCHEMA)
            raise

    def newest(self, flows: Sequence[str]) -> dict[tuple[str, str], str]:
        """The current cursor of every (flow, column), for the named flows."""
        mine = self.rows().filter(F.col("flow").isin(*flows))
        last = mine.groupBy("flow", "cursor_column").agg(
            F.max_by("cursor_value", F.struct("recorded_at", "run_id")).alias("value"))
        return {(r["flow"], r["cursor_column"]): r["value"] for r in last.collect()}

    def get(self, flow: str, column: str) -> str | None:
        return self.newest([flow]).get((flow, column))

    def put(self, marks: Sequence[tuple[str, str, str, Any]], run_id: str) -> None:
        """Record ``(flow, column, type, value)`` rows in one append.

        A value of None stands for an empty increment and keeps the old cursor.
        """
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        rows = [{"flow": flow, "cursor_column": column, "cursor_type": kind,
                 "cursor_value": _cursor_text(value), "run_id": run_id, "recorded_at": now.isoformat()}
                for flow, column, kind, value in marks if value is not None]
        if rows:
            literal_rows(self.spark, rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def _cursor_text(value: Any) -> str:
    return value.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(value, datetime) else str(value)


def _as_text(value: Column, dtype: T.DataType) -> Column:
    """Text that means the same moment whatever the session's time zone will be next time."""
    if isinstance(dtype, T.TimestampType):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
    return value.cast("string")


def bounded_increment(df: DataFrame, config: CdcConfig, last: Any, until: Any) -> DataFrame:
    """The increment of a window that ``upper_bounds`` has measured; empty if it found nothing there."""
    if until is not None:
        return apply_cdc(df, config, last, until)
    if config.nulls == "keep":
        return df.filter(F.col(config.column).isNull())
    return df.filter(F.lit(False))


def upper_bounds(increments: Sequence[tuple[DataFrame, CdcConfig, Any]]) -> list[str | None]:
    """Largest cursor value of each increment ``(source, config, last)``, as text, in one job.

    Read before the increments themselves, they close the windows: rows that arrive meanwhile belong
    to the next load, and a task that is run again reads the same rows. Only cursor columns are scanned.
    """
    if not increments:
        return []
    tops = [apply_cdc(df.select(config.column), config, last)
            .agg(_as_text(F.max(config.column), df.schema[config.column].dataType).alias("upper"))
            .select(F.lit(n).alias("n"), "upper")
            for n, (df, config, last) in enumerate(increments)]
    found = {r["n"]: r["upper"] for r in reduce(DataFrame.unionByName, tops).collect()}
    return [found[n] for n in range(len(increments))]
