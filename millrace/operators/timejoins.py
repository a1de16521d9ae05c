"""Joins on nearness: the last row before a moment, the intervals around a moment, values within a band.

None of them is a range join for Spark: every one becomes a join or window on equal keys over slices of the ordered
column, so no plan has a nested loop. A hot key spreads over its slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.keys import as_keys, has_order, keyed, order_columns, require_columns

# Slices that an as-of join divides the whole range into.
SLICES = 256
# Rows of one side of a band that meet in one cell; pairs that one task compares, about; how many pairs a shuffled row costs; tasks at most.
BIN_ROWS = 1_000
TASK_PAIRS = 8_000_000
ROW_PAIRS = 16
MOST_TASKS = 20_000


def _number(column: Column, dtype: T.DataType) -> Column:
    """An ordered value as a double or a number of microseconds: what slices are cut from. It never falls where the value grows."""
    if isinstance(dtype, T.TimestampNTZType):
        # Not by way of an instant: zones have hours that come twice.
        seconds = F.unix_date(column.cast("date")).cast("bigint") * 86_400 + F.hour(column) * 3_600 + F.minute(column) * 60 + F.second(column)
        return seconds * 1_000_000
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return F.unix_micros(column.cast("timestamp"))
    return column.cast("double")


def _range_of(left: DataFrame, left_at: str, right: DataFrame, right_at: str) -> tuple[Any, Any] | None:
    both = (left.select(_number(F.col(left_at), left.schema[left_at].dataType).alias("x"))
            .unionByName(right.select(_number(F.col(right_at), right.schema[right_at].dataType).alias("x"))))
    both = both.filter(F.col("x").isNotNull() & ~F.col("x").cast("double").isin(float("nan"), float("inf"), float("-inf")))
    low, high = both.agg(F.min("x"), F.max("x")).first()
    return None if low is None else (low, high)


def asof_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], left_at: str, right_at: str, *, how: str = "left",
              order_by: Any = None, slices: int = SLICES) -> DataFrame:
    """Each row of ``left`` with the newest row of its key in ``right`` that is not later: ``right_at <= left_at``.

    Of several right rows of one key and moment the first in ``order_by`` counts (plain names sort descending; without it, any of them).
    Left rows without such a row, or whose key or moment is NULL, have NULLs (``how="left"``) or go (``"inner"``). The right columns but the keys are added; names must differ.

    Both sides are stacked, sorted and carried forward within key *and* slice of the ordered column. The last row of each slice, one per key
    and slice, is then carried over to later slices - so no task holds a key's whole history, and one key's rows sort in as many tasks as it has slices.
    """
    keys = as_keys(keys)
    added = [c for c in right.columns if c not in keys]
    require_columns(left, [*keys, left_at], "left side")
    require_columns(right, [*keys, right_at], "right side")
    clash = sorted(set(added) & set(left.columns))
    if clash:
        raise ValueError(f"both sides have {', '.join(clash)}")
    if how not in ("left", "inner"):
        raise ValueError(f"how must be 'left' or 'inner', not {how!r}")
    ends = _range_of(left, left_at, right, right_at)
    low, high = ends or (0, 1)
    width = max((high - low) / slices, 1) if isinstance(low, int) else max((high - low) / slices, 1e-300)

    def sliced(df: DataFrame, at: str) -> Column:
        place = (_number(F.col(at), df.schema[at].dataType) - F.lit(low)) / F.lit(width)
        # NaN is the largest value, for least() as for sorting.
        return F.floor(F.greatest(F.least(place, F.lit(float(slices))), F.lit(-1.0))).cast("int")

    row, item, at, cut, side = "__row", "__item", "__at", "__slice", "__side"
    common = T.StructType([*left.schema.fields])
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    payload = F.struct(*[F.col(f"`{c}`") for c in added])
    usable = left.filter(keyed(keys) & F.col(left_at).isNotNull())
    rest = left.filter(~(keyed(keys) & F.col(left_at).isNotNull()))
    order = [f"__o{n}" for n in range(len(order_columns(order_by)))] if has_order(order_by) else []
    newest = right.filter(keyed(keys) & F.col(right_at).isNotNull())
    if order:
        one = Window.partitionBy(*keys, right_at).orderBy(*order_columns(order_by))
        newest = newest.withColumn("__first", F.row_number().over(one)).filter("__first = 1").drop("__first")
    typed = left.schema[left_at].dataType
    mine = usable.select(*keys, F.col(left_at).alias(at), sliced(usable, left_at).alias(cut), F.lit(1).alias(side), whole.alias(row))
    theirs = newest.select(*[F.col(k).cast(left.schema[k].dataType).alias(k) for k in keys], F.col(right_at).cast(typed).alias(at),
                           sliced(newest, right_at).alias(cut), F.lit(0).alias(side), payload.alias(item))
    stacked = mine.unionByName(theirs, allowMissingColumns=True)

    # One row per key and slice: what it ends with, and whether anyone in it may need what came before.
    last = F.max_by(item, F.when(F.col(side) == 0, F.col(at)))
    tops = stacked.groupBy(*keys, cut).agg(last.alias(item), F.max(side).alias(side))
    before = Window.partitionBy(*keys).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    carried = (tops.withColumn(item, F.last(item, ignorenulls=True).over(before)).filter((F.col(side) == 1) & F.col(item).isNotNull())
               .select(*keys, F.lit(None).cast(typed).alias(at), cut, F.lit(-1).alias(side), item))
    within = Window.partitionBy(*keys, cut).orderBy(F.col(at).asc_nulls_first(), side).rowsBetween(Window.unboundedPreceding, 0)
    found = (stacked.unionByName(carried, allowMissingColumns=True).withColumn(item, F.last(item, ignorenulls=True).over(within))
             .filter(F.col(side) == 1))
    if how == "inner":
        found = found.filter(F.col(item).isNotNull())
    out = found.select(*[F.col(f"{row}.`{f.name}`").alias(f.name) for f in common.fields], *[F.col(f"{item}.`{c}`").alias(c) for c in added])
    if how == "inner":
        return out
    return out.unionByName(rest.select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in added]))


def interval_join(points: DataFrame, intervals: DataFrame, keys: str | Sequence[str], at: str, start: str, end: str, *, width: Any) -> DataFrame:
    """All pairs of equal keys with ``start <= at < end``; NULL in any of them matches nothing. The interval's columns but the keys are added.

    Time is cut into bins of ``width`` (microseconds for times, else plain numbers), and again into bins of twice that, four times, and so on.
    An interval lies in at most two bins of the level of its own length; a point is looked up once per level that occurs, of which
    there are few. So a long interval costs no more rows than a short one. Both sides are shuffled and sorted: a point has as many rows as there
    are levels, which Spark's estimate of a side's size does not know, so a side that looks small enough to be broadcast need not be.
    """
    keys = as_keys(keys)
    require_columns(points, [*keys, at], "points")
    require_columns(intervals, [*keys, start, end], "intervals")
    clash = sorted((set(intervals.columns) - set(keys)) & set(points.columns))
    if clash:
        raise ValueError(f"both sides have {', '.join(clash)}")
    if width <= 0:
        raise ValueError("width must be positive")
    level, slot = "__level", "__slot"
    # Microseconds are whole numbers up to 2^53 here (some 285 years from 1970); bins are only where pairs are looked for.
    first, beyond = (_number(F.col(c), intervals.schema[c].dataType).cast("double") for c in (start, end))
    usable = intervals.filter(keyed([*keys, start, end]) & (F.col(start) < F.col(end)))
    levels = F.greatest(F.ceil(F.log2((beyond - first) / F.lit(float(width)))), F.lit(0)).cast("int")
    sized = usable.withColumn(level, levels)
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col(level))
    placed = sized.withColumn(slot, F.explode(F.sequence(F.floor(first / size), F.floor(beyond / size))))
    present = [r[level] for r in sized.select(level).distinct().collect()]            # a few dozen numbers
    place = _number(F.col(at), points.schema[at].dataType).cast("double")
    looked = (points.filter(keyed([*keys, at])).withColumn(level, F.explode(F.array(*map(F.lit, present)).cast("array<int>")))
              .withColumn(slot, F.floor(place / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col(level))))))
    pairs = looked.hint("merge").join(placed, [*keys, level, slot]).filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end)))
    return pairs.select(*points.columns, *[c for c in intervals.columns if c not in keys])


def band_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, band: Any, *, bin_rows: int = BIN_ROWS) -> DataFrame:
    """All pairs with ``abs(left_on - right_on) <= band``, without any key that must be equal. Names must differ; NULL, NaN and infinite values match nothing.

    Values are cut into bins of the band's width; a right row is looked for in its own bin and both neighbours. A bin with more than
    ``bin_rows`` rows on a side is a grid of cells: each side is dealt over one direction and repeated along the other, so no task gets a
    whole overfull bin, and every pair still meets in one cell only. Pairs can grow with the product of the sides, so the cells are dealt to
    as many tasks as the pairs to be compared ask for (they are counted first), not as the bytes of the sides do.
    """
    require_columns(left, [left_on], "left side")
    require_columns(right, [right_on], "right side")
    clash = sorted(set(left.columns) & set(right.columns))
    if clash:
        raise ValueError(f"both sides have {', '.join(clash)}")
    if band < 0:
        raise ValueError("the band must not be negative")
    a, b = F.col(left_on), F.col(right_on)
    # An empty band has bins, too. Bins are a little wider than the band, so that rounding in the division cannot leave a pair out.
    width = F.lit(float(band) * (1 + 1e-9) if band else 1.0)
    bin_, i, j, rows, columns = "__bin", "__i", "__j", "__rows", "__columns"
    edge = F.lit(float(1 << 62))

    def home(column: Column) -> Column:
        return F.floor(F.greatest(F.least(column.cast("double") / width, edge), -edge))

    mine = left.filter(F.abs(a.cast("double")) < float("inf")).withColumn(bin_, home(a))
    theirs = (right.filter(F.abs(b.cast("double")) < float("inf"))
              .withColumn(bin_, F.explode(F.array(home(b) - 1, home(b), home(b) + 1))))
    lefts, rights = "__lefts", "__rights"
    both = mine.select(bin_, F.lit(1).alias(lefts), F.lit(0).alias(rights)).unionByName(theirs.select(bin_, F.lit(0).alias(lefts), F.lit(1).alias(rights)))
    sizes = (both.groupBy(bin_).agg(F.sum(lefts).cast("double").alias(lefts), F.sum(rights).cast("double").alias(rights))
             .withColumn(rows, F.ceil(F.col(lefts) / bin_rows).cast("int")).withColumn(columns, F.ceil(F.col(rights) / bin_rows).cast("int"))
             .filter(f"{rows} > 0 AND {columns} > 0"))
    work = sizes.agg(F.sum(F.expr(f"{lefts} * {rights} + {ROW_PAIRS} * ({lefts} * {columns} + {rights} * {rows})"))).first()[0] or 0.0
    tasks = min(max(ceil(work / TASK_PAIRS), 1), MOST_TASKS)
    # One row for bin_rows rows or more: small, and no overfull bin is shuffled whole.
    grid = F.broadcast(sizes.filter(f"{rows} > 1 OR {columns} > 1").select(bin_, rows, columns))
    mine = mine.join(grid, bin_, "left").withColumn(i, _dealt(left, rows)).withColumn(j, _repeated(columns)).drop(rows, columns)
    theirs = theirs.join(grid, bin_, "left").withColumn(j, _dealt(right, columns)).withColumn(i, _repeated(rows)).drop(rows, columns)
    mine, theirs = (side.repartition(tasks, bin_, i, j) for side in (mine, theirs))
    pairs = mine.hint("merge").join(theirs, [bin_, i, j]).filter(F.abs(a - b) <= F.lit(band))
    return pairs.select(*left.columns, *right.columns)


def _dealt(df: DataFrame, copies: str) -> Column:
    """A row's place among ``copies``, from its contents; rows that are alike in all hashable columns are dealt alike."""
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return F.pmod(F.xxhash64(*hashable), F.coalesce(F.col(copies), F.lit(1))).cast("int")


def _repeated(copies: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(copies), F.lit(1)) - 1))
