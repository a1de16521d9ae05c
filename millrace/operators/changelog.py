"""Applying a log of inserts, updates and deletes to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import (align, as_keys, keyed, latest_per_key, require_columns)

# Operation codes of a change log.
INSERT, UPDATE, DELETE = "I", "U", "D"


def net_changes(log: DataFrame, keys: str | Sequence[str], seq: str | Sequence[str] = "seq") -> DataFrame:
    """The last entry of every key; earlier ones have no effect on the outcome."""
    return latest_per_key(log, keys, seq)


def apply_change_log(target: DataFrame, log: DataFrame, keys: str | Sequence[str],
                     seq: str | Sequence[str] = "seq", op: str = "op", *,
                     broadcast_log: bool = False) -> DataFrame:
    """``target`` after replaying ``log`` in ``seq`` order.

    The last entry of a key decides: a delete removes the row, anything else becomes the row. An
    unknown operation fails the query. Log rows without a key match nothing and are inserted, unless
    they are deletes. Target rows without a key bypass the join.
    """
    names = as_keys(keys)
    require_columns(log, [*names, op, *([seq] if isinstance(seq, str) else seq)], "change log")
    require_columns(target, names, "target")
    payload = target.columns
    require_columns(log, payload, "change log")

    known = F.when(F.col(op).isin(INSERT, UPDATE, DELETE), F.col(op)).otherwise(
        F.raise_error(F.concat(F.lit("unknown change log operation: "),
                               F.coalesce(F.col(op), F.lit("NULL")))))
    log = log.withColumn(op, known)
    last = net_changes(log.filter(keyed(names)), names, seq)
    # Only the set of keys matters here; it is folded before the shuffle, whatever their frequency.
    matched = log.filter(keyed(names)).select(*names).distinct()
    kept = target.filter(keyed(names)).join(
        F.broadcast(matched) if broadcast_log else matched, names, "left_anti").select(*payload)
    columns = align(log, target.schema, payload)
    rows = last.filter(F.col(op) != DELETE).select(*columns)
    keyless = log.filter(~keyed(names) & (F.col(op) != DELETE)).select(*columns)
    return (kept.unionByName(target.filter(~keyed(names)))
                .unionByName(rows).unionByName(keyless))
