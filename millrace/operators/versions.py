"""Append-only version history of keyed records."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import (as_keys, keyed, latest_per_key, one_row_per_key,
                                     require_columns)

# Fixed value: the characters Python's str.strip() removes.
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

_OLD_VERSION, _OLD_DIGEST = "__version", "__digest"


def latest(history: DataFrame, keys: str | Sequence[str], version: str = "version") -> DataFrame:
    """The newest version of every key."""
    return latest_per_key(history, keys, version)


def at_version(history: DataFrame, number: int, version: str = "version") -> DataFrame:
    """Version ``number`` of every key that has it."""
    return history.filter(F.col(version) == F.lit(number))


def version_history(history: DataFrame, keys: str | Sequence[str], version: str = "version") -> DataFrame:
    """All versions, newest first within each key. Filter on the key first for a single record."""
    return history.orderBy(*as_keys(keys), F.col(version).desc())


def text_digest(payload: str):
    """Fingerprint of a text without its outer blanks; NULL stays NULL."""
    return F.sha2(F.trim(F.col(payload), F.lit(BLANKS)), 256)


def changed_versions(history: DataFrame, incoming: DataFrame, keys: str | Sequence[str],
                     payload: str, version: str = "version", *, order_by: Any = None,
                     digest: str | None = None) -> DataFrame:
    """The rows ``incoming`` adds to ``history``: new keys as 1, changed payloads as the next number.

    Payloads are compared without outer blanks, by digest: old texts are neither shuffled nor joined.
    Keys with NULL in them equal nothing and always count as new. ``digest`` names a column in which the
    history keeps the fingerprint of each text: then no old text is read, and new rows get theirs.
    """
    names = as_keys(keys)
    require_columns(history, [*names, payload, version, *([digest] if digest else [])], "history")
    require_columns(incoming, [*names, payload], "incoming")
    number = history.schema[version].dataType
    others = [c for c in history.columns if c not in (version, digest) and c in incoming.columns]
    marks = [text_digest(payload).alias(digest)] if digest else []

    known = latest(
        history.filter(keyed(names))
               .select(*names, F.col(version).alias(_OLD_VERSION), (F.col(digest) if digest else text_digest(payload)).alias(_OLD_DIGEST)),
        names, _OLD_VERSION)
    fresh = one_row_per_key(incoming.filter(keyed(names)), names, order_by, "incoming versions")
    compared = fresh.join(known, names, "left")
    same = F.col(_OLD_VERSION).isNotNull() & text_digest(payload).eqNullSafe(F.col(_OLD_DIGEST))
    added = compared.filter(~same).select(
        *others, (F.coalesce(F.col(_OLD_VERSION), F.lit(0)) + 1).cast(number).alias(version), *marks)
    keyless = incoming.filter(~keyed(names)).select(*others, F.lit(1).cast(number).alias(version), *marks)
    return added.unionByName(keyless)


def append_if_changed(history: DataFrame, incoming: DataFrame, keys: str | Sequence[str],
                      payload: str, version: str = "version", *, order_by: Any = None,
                      digest: str | None = None) -> DataFrame:
    """``history`` with the changed and new records of ``incoming`` appended as new versions."""
    added = changed_versions(history, incoming, keys, payload, version, order_by=order_by, digest=digest)
    return history.unionByName(added, allowMissingColumns=True)
