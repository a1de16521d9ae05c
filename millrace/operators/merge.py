"""Upsert: update the rows whose key is in the target, insert the others."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import (align, all_of, as_keys, has_order, keyed, one_row_per_key,
                                     require_columns, require_comparable)


def upsert(target: DataFrame, source: DataFrame, keys: str | Sequence[str], *, order_by: Any = None,
           null_safe: bool = False, repeated_target_keys: bool = False,
           broadcast_source: bool = False) -> DataFrame:
    """``target`` with every row of ``source`` merged in by ``keys``.

    - A source row replaces the target row of its key, or is added.
    - A key with NULL in it matches nothing: such target rows stay, such source rows are added. With
      ``null_safe=True`` NULL equals NULL.
    - A key that occurs twice in the source fails the query, unless ``order_by`` picks the newest.
    - Columns are those of the target; the source must have them all, and may have more.
    - Target keys are taken to be unique, which upserts keep so. With ``repeated_target_keys=True``
      every target row of a matched key is updated, at the price of a second join on the key columns.

    The target's rows go through one anti join against the source's keys: that side may be broadcast
    (``broadcast_source``, for a source of checked size), and Spark can split a skewed target.
    """
    names = as_keys(keys)
    columns = target.columns
    require_columns(target, names, "target")
    require_columns(source, columns, "source")
    require_comparable(target, names, "key")

    aligned = align(source, target.schema, columns)
    extra = [c for c in source.columns if c not in columns]
    prepared = source.select(*aligned, *extra)
    if null_safe:
        matching, loose = prepared, None
        bypass, old = None, target
    else:
        matching, loose = prepared.filter(keyed(names)), prepared.filter(~keyed(names))
        bypass, old = target.filter(~keyed(names)), target.filter(keyed(names))
    # Repeats are harmless on the key side of the anti join; where they are expected, they are folded
    # before the shuffle, so a key that fills a third of the source arrives once per map task.
    source_keys = matching.select(*names)
    source_keys = source_keys.distinct() if has_order(order_by) else source_keys
    matching = one_row_per_key(matching, names, order_by, "upsert source").select(*columns)
    kept = _join(old, F.broadcast(source_keys) if broadcast_source else source_keys,
                 names, "left_anti", null_safe)
    if repeated_target_keys:
        old_keys = old.select(*names)
        updated = _join(matching, old_keys, names, "inner", null_safe)
        added = _join(matching, old_keys.distinct(), names, "left_anti", null_safe)
        changed = updated.select(*columns).unionByName(added)
    else:
        changed = matching
    result = kept.select(*columns).unionByName(changed)
    for rest in (bypass, loose):
        if rest is not None:
            result = result.unionByName(rest.select(*columns))
    return result


def _join(left: DataFrame, right: DataFrame, names: Sequence[str], how: str,
          null_safe: bool) -> DataFrame:
    if not null_safe:
        return left.join(right, list(names), how)
    renamed = right.select(*[F.col(n).alias(f"__r_{n}") for n in names])
    same = all_of([F.col(n).eqNullSafe(F.col(f"__r_{n}")) for n in names])
    return left.join(renamed, same, how).select(*left.columns)


def merge_into_table(source: DataFrame, table: str, keys: str | Sequence[str], *,
                     order_by: Any = None, null_safe: bool = False) -> None:
    """The same upsert as a MERGE run by a table format that supports it (Iceberg).

    Columns are addressed as columns, so no name is ever pasted into SQL text.
    """
    names = as_keys(keys)
    if has_order(order_by):
        if null_safe:
            source = one_row_per_key(source, names, order_by, "merge source")
        else:
            source = one_row_per_key(source.filter(keyed(names)), names, order_by, "merge source"
                                     ).unionByName(source.filter(~keyed(names)))
    source = source.alias("s")
    pairs = [(F.col(f"{table}.`{n}`"), F.col(f"s.`{n}`")) for n in names]
    same = all_of([a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])
    (source.mergeInto(table, same)
           .whenMatched().updateAll()
           .whenNotMatched().insertAll()
           .merge())
