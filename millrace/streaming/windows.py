"""Event-time windows over arriving files: tumbling, sliding and session windows with a watermark.

A call reads all files that have arrived since the last one and stops; the checkpoint keeps the open windows and the
watermark in between. A window is written once, when the watermark has passed its end: the largest event time seen less ``delay``. Rows
that come after that for a closed window are dropped and counted. The state holds open windows only: partial aggregates,
one row per key and window, put together before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.keys import as_keys, require_columns

_WINDOW = "__window"


@dataclass(frozen=True)
class Windows:
    """Which windows: ``size`` alone tumbles, with ``slide`` it slides; ``gap`` makes sessions of rows closer than that."""

    size: str | None = None
    slide: str | None = None
    gap: str | None = None

    def __post_init__(self):
        if (self.size is None) == (self.gap is None):
            raise ValueError("give either 'size' (with or without 'slide') or 'gap'")
        if self.slide and self.gap:
            raise ValueError("sessions do not slide")

    def column(self, at: str):
        if self.gap:
            return F.session_window(at, self.gap)
        return F.window(at, self.size, self.slide) if self.slide else F.window(at, self.size)


@dataclass(frozen=True)
class StreamRun:
    """What a call did. ``frame`` is lazy: all windows written so far."""

    frame: DataFrame
    rows_read: int
    late: int               # groups of late rows, as each task put them together
    watermark: str | None   # where it stands now


def windowed(rows: DataFrame, at: str, windows: Windows, aggregates: Mapping[str, str], keys: str | Sequence[str] = (), delay: str = "0 seconds") -> DataFrame:
    """Aggregates (name -> SQL expression) per key and window, for a stream or a table: keys, ``window_start``, ``window_end``, aggregates.

    Rows without a time are left out. For a table ``delay`` means nothing: every window is there.
    """
    names = as_keys(keys) if keys else []
    require_columns(rows, [*names, at], "input")
    plain = isinstance(rows.schema[at].dataType, T.TimestampNTZType)
    timed = rows.filter(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    grouped = timed.groupBy(*names, windows.column(at).alias(_WINDOW)).agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])
    kind = "timestamp_ntz" if plain else "timestamp"
    return grouped.select(*names, F.col(f"{_WINDOW}.start").cast(kind).alias("window_start"), F.col(f"{_WINDOW}.end").cast(kind).alias("window_end"), *aggregates)


def stream_windows(spark: SparkSession, path: str, schema: Any, at: str, windows: Windows, aggregates: Mapping[str, str], *, target: str, checkpoint: str,
                   keys: str | Sequence[str] = (), delay: str = "0 seconds", format: str = "parquet", options: Mapping[str, Any] | None = None,
                   max_files: int | None = None) -> StreamRun:
    """Take in all files that have arrived at ``path``; closed windows are appended to the Parquet folder ``target``, each exactly once."""
    reader = spark.readStream.format(format).schema(schema).options(**dict(options or {}))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    closed = windowed(reader.load(path), at, windows, aggregates, keys, delay)
    query = (closed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    steps = query.recentProgress
    late = sum(s.numRowsDroppedByWatermark for p in steps for s in p.stateOperators)
    marks = [p.eventTime["watermark"] for p in steps if p.eventTime.get("watermark")]
    return StreamRun(spark.read.schema(closed.schema).parquet(target), sum(p.numInputRows for p in steps), late, marks[-1] if marks else None)
