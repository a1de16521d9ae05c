"""Key handling shared by upsert, SCD2, change-log apply and version append.

A key that holds NULL equals nothing, so such rows never need a join. They are split off before the
shuffle: left in, they would all hash to one partition, however many of them there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROW_NUMBER = "__rn"


def as_keys(keys: str | Sequence[str]) -> list[str]:
    names = [keys] if isinstance(keys, str) else list(keys or [])
    if not names:
        raise ValueError("at least one key column is needed")
    return names


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def keyed(keys: Sequence[str]) -> Column:
    """True where every key column has a value; never NULL itself."""
    return all_of([F.col(k).isNotNull() for k in keys])


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} has no column {', '.join(missing)}")


def holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(holds_map(f.dataType) for f in dtype.fields)
    return False


def require_comparable(df: DataFrame, names: Sequence[str], what: str) -> None:
    bad = [n for n in names if holds_map(df.schema[n].dataType)]
    if bad:
        raise ValueError(f"{what} cannot be compared, it holds a map: {', '.join(bad)}")


def order_columns(order_by: str | Column | Sequence[str | Column]) -> list[Column]:
    """Newest first; a plain name means descending with NULL last."""
    items = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return [F.col(c).desc_nulls_last() if isinstance(c, str) else c for c in items]


def has_order(order_by: Any) -> bool:
    return isinstance(order_by, Column) or bool(order_by)


def latest_per_key(df: DataFrame, keys: str | Sequence[str],
                   order_by: str | Column | Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in ``order_by`` (plain names sort descending).

    ``row_number() = 1`` lets Spark keep only the best row of every key *before* the shuffle
    (WindowGroupLimit), so a key that owns a third of all rows costs one row per map task.
    """
    names = as_keys(keys)
    require_columns(df, names, "input")
    window = Window.partitionBy(*names).orderBy(*order_columns(order_by))
    return (df.withColumn(_ROW_NUMBER, F.row_number().over(window))
              .filter(F.col(_ROW_NUMBER) == 1)
              .drop(_ROW_NUMBER))


def fail_on_repeated_keys(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The same rows, but the query fails at the second row of any key.

    The check streams: it needs the hash partitioning and the sort that a sort-merge join on the
    same keys needs anyway, and it never buffers a group.
    """
    window = Window.partitionBy(*keys).orderBy(*keys)
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])
    repeated = F.raise_error(F.concat(F.lit(f"repeated key in {what}: "), shown)).cast("boolean")
    return (df.withColumn(_ROW_NUMBER, F.row_number().over(window))
              .filter(F.when(F.col(_ROW_NUMBER) == 1, F.lit(True)).otherwise(repeated))
              .drop(_ROW_NUMBER))


def one_row_per_key(df: DataFrame, keys: Sequence[str], order_by: Any, what: str) -> DataFrame:
    """De-duplicate by ``order_by`` when it is given, else insist that keys are unique."""
    if has_order(order_by):
        return latest_per_key(df, keys, order_by)
    return fail_on_repeated_keys(df, keys, what)


def align(source: DataFrame, target_schema: T.StructType, names: Sequence[str]) -> list[Column]:
    """``names`` of the source, cast to the target's types where they differ."""
    out = []
    for n in names:
        want = target_schema[n].dataType
        have = source.schema[n].dataType
        out.append(F.col(n) if have == want else F.col(n).cast(want).alias(n))
    return out
