"""Repeated passages: every byte under a ``LENGTH``-byte string that also starts earlier in the corpus is removed.

Suffixes are sorted by sampling and induction, in the external sorts of Spark's shuffles:

1. *Sample.* Every window of ``LENGTH`` bytes has an anchor, the smallest-hashed ``HEAD``-byte string in it. Equal windows
   have their anchors at the same offset, so only suffixes at anchors are tupled: about one per 35 positions. A run is the row of
   neighbouring windows that share an anchor.
2. *Sort the sample.* Tuples whose head occurs once have no common prefix of ``LENGTH`` with anything and leave.
3. *Induce from whole runs.* Runs with equal heads and equal bytes (of all their windows) have equal windows throughout: all but
   the earliest are removed as they stand, and the earliest alone goes on.
4. *Recur where runs differ.* Earliest runs that share a head and not their bytes are taken apart into blocks of
   ``BLOCK`` neighbouring windows by their distance from the anchor. The bytes common to all windows of a block are its head,
   and steps 2 and 3 are repeated: only blocks whose heads meet go on, equal ones are removed, and the rest is taken
   apart into windows; all but the earliest of equal windows are removed.

Comparisons use two numbers together: 64 bits of a head's digest, and 64 of a run's or block's. Of a window, all bytes outside its block's head
and its place are kept as they are, so windows under one head are never confused. Repeated tuples are pre-aggregated before a shuffle; joins
back to rows can be split at hot keys. A task holds one chunk of texts, or its longest text, some forty times over.

Defined cases: NULL text is empty; texts shorter than ``LENGTH`` lose nothing; bytes are those of UTF-8, so a cut may fall inside a
character; a row is a place of its own: places are ordered by id, NULL ids after all others, and by a digest of the text where ids are NULL or
repeat; only rows that repeat both an id and its text are one place, so none of them is earlier than the other;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shingles
from millrace.llm.common import small, staged

LENGTH = 100
HEAD = 32
BLOCK = 8                    # at most 8: a window's bytes outside its block's head, and its place, are one 64-bit number
_LAST = 2 ** 63 - 1
_LOOSE = 2 ** 62                # ties from here on are those of NULL ids

_U = np.uint64


class Bytes:
    """Texts end to end, with digests of any of their stretches."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes + 1) - 1
        self.starts = self.ends - self.sizes
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        values = shingles.BYTE_VALUES[data]
        values *= shingles.power_table(len(data), shingles.BASE)
        self.prefix = np.concatenate((np.zeros(1, _U), np.cumsum(values, dtype=_U)))
        self.inverse = shingles.power_table(len(data), shingles.INVERSE)

    def digest(self, at: np.ndarray, size: np.ndarray | int, seed: int) -> np.ndarray:
        return shingles.mixed((self.prefix[at + size] - self.prefix[at]) * self.inverse[at], seed)


def runs(data: Bytes, length: int = LENGTH, head: int = HEAD) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, head digest, run digest, anchor less first window) of all runs, in order."""
    total = len(data.prefix) - 1
    if total < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U, np.int64))
    bits = _U(total.bit_length())
    grams = data.digest(np.arange(total - head + 1), head, 41)
    key = ((grams >> bits) << bits) | np.arange(len(grams), dtype=_U)
    width, span = length - head + 1, 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    key = np.minimum(key[:total - length + 1], key[width - span:width - span + total - length + 1])
    anchor = (key & ((_U(1) << bits) - _U(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(data.sizes)), data.sizes + 1)[:len(anchor)]
    inside = np.flatnonzero(np.arange(len(anchor)) + length <= data.ends[owner])
    if not len(inside):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U, np.int64))
    breaks = np.flatnonzero((anchor[inside][1:] != anchor[inside][:-1]) | (inside[1:] != inside[:-1] + 1)) + 1
    first = inside[np.concatenate(([0], breaks))]
    last = inside[np.concatenate((breaks - 1, [len(inside) - 1]))]
    at = anchor[first]
    whole = data.digest(first, last + length - first, 42) ^ shingles.mixed((at - first).astype(_U), 43)
    return owner[first], first - data.starts[owner[first]], last - first + 1, grams[at], whole, at - first


def window_rests(text: bytes, at: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The ``BLOCK - 1`` bytes of each window at ``at`` that its block's head leaves out, ``before`` of them ahead of the head."""
    data = np.frombuffer(text, np.uint8)
    rest = before.astype(_U)
    for k in range(BLOCK - 1):
        rest = (rest << _U(8)) | data[at + k + np.where(k < before, 0, LENGTH - BLOCK + 1)].astype(_U)
    return rest.view(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (text for _, _, texts in shingles.text_chunks(batch.column("text")) for text in texts)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, texts in shingles.text_chunks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(runs(Bytes(texts))[3].view(np.int64))], names=["head"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tie"))
        for a, b, texts in shingles.text_chunks(batch.column("text")):
            owner, first, windows, head, whole, reach = runs(Bytes(texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(head.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[a:b][owner]), pa.array(ties[a:b][owner]),
                 pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int16)), pa.array(reach.astype(np.int16))],
                names=["head", "run", "id", "tie", "first", "windows", "reach"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, tie, text, parts: list of first, windows, reach) to one row per block of each part, with the rests of its windows."""
    for batch in batches:
        for number, tie, text, parts in zip(batch.column("id").to_pylist(), batch.column("tie").to_pylist(), _texts(batch), batch.column("parts").to_pylist()):
            data = Bytes([text])
            first, many, reach = (np.array([p[c] for p in parts], np.int64) for c in ("first", "windows", "reach"))
            part = np.repeat(np.arange(len(parts)), many)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[part]
            anchor = (first + reach)[part]
            block = (anchor - at) // BLOCK
            begins = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (block[1:] != block[:-1]))))
            ends = np.concatenate((begins[1:], [len(at)]))
            low, count, number_of = at[begins], ends - begins, block[begins]
            head_at = anchor[begins] - number_of * BLOCK
            head = data.digest(head_at, LENGTH - BLOCK + 1, 45) ^ shingles.mixed(number_of.astype(_U), 46)
            whole = data.digest(low, LENGTH + count - 1, 47) ^ shingles.mixed((head_at - low + BLOCK).astype(_U), 48)
            windows = window_rests(text, at, (anchor - at) % BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(head.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(np.full(len(low), number, np.int64)), pa.array(np.full(len(low), tie, np.int64)),
                 pa.array(low.astype(np.int32)), pa.array(count.astype(np.int16)),
                 pa.ListArray.from_arrays(pa.array(np.concatenate((begins, [len(at)])), pa.int32()), pa.array(windows))],
                names=["head", "run", "id", "tie", "first", "windows", "rests"])


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left) of ``text`` without ``spans``, which may overlap."""
    kept, removed, count, done = [], 0, 0, 0
    end_of_run = -1
    for begin, end in sorted(spans):
        end = min(end, len(text))
        if begin > end_of_run:
            count += 1
            kept.append(text[done:begin])
            done = begin
        if end > done:
            removed += end - done
            done = end
        end_of_run = max(end_of_run, end)
    kept.append(text[done:])
    return removed, count, b"".join(kept)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for number, text, spans in zip(batch.column("doc_id").to_pylist(), _texts(batch), batch.column("spans").to_pylist()):
            removed, count, left = cut(text, [(s["begin"], s["end"]) for s in spans or ()])
            rows.append((number, len(text), removed, count, hashlib.sha256(left).hexdigest(), left))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def _classes(tuples: DataFrame) -> DataFrame:
    """Tuples with equal heads and bytes as one: head, run, windows, the earliest one's id, tie and first, and their number."""
    grouped = tuples.groupBy("head", "run", "windows").agg(F.min(F.struct("id", "tie", "first")).alias("e"), F.count(F.lit(1)).alias("n"))
    return staged(grouped.select("head", "run", "windows", F.col("e.id").alias("id1"), F.col("e.tie").alias("tie1"),
                                 F.col("e.first").alias("first1"), "n"), "suffix-classes")


def _later(tuples: DataFrame, classes: DataFrame) -> DataFrame:
    """The stretches of all but the earliest tuple of each class."""
    several = classes.where("n > 1").drop("n")
    return (tuples.join(several, ["head", "run", "windows"]).where("id <> id1 OR tie <> tie1 OR first <> first1")
            .select("id", "tie", F.col("first").alias("begin"), (F.col("first") + F.col("windows") - 1 + LENGTH).alias("end")))


def _differing(tuples: DataFrame, classes: DataFrame) -> DataFrame:
    """The earliest tuple of each class, where other classes have its head."""
    heads = classes.groupBy("head").agg(F.count(F.lit(1)).alias("heads")).where("heads > 1").select("head")
    open_classes = classes.join(heads, "head", "left_semi").drop("n")
    return (tuples.join(open_classes, ["head", "run", "windows"])
            .where("id = id1 AND tie = tie1 AND first = first1").drop("id1", "tie1", "first1"))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, id, tie, text: ``id`` and ``tie`` order the rows and tell them apart, but for those that repeat both id and text.

    Where ids are there and differ, ``tie`` is 0. Rows without an id are numbered in the order of their texts, and staged, so
    that a number stays with its row.
    """
    number = F.col("doc_id").cast("bigint")
    texts = docs.select(number.alias("doc_id"), F.coalesce(number, F.lit(_LAST)).alias("id"), F.col("text").cast("string").alias("text"))
    known, loose = texts.where("doc_id IS NOT NULL"), texts.where("doc_id IS NULL")
    digest = F.xxhash64("text").bitwiseAND(F.lit(_LOOSE - 1))
    again = staged(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again")), "suffix-again")
    tie = F.lit(0).cast("bigint")
    if not again.isEmpty():
        known, tie = known.join(small(again), "doc_id", "left"), F.when(F.col("again"), digest).otherwise(tie)
    known = known.select("doc_id", "id", tie.alias("tie"), "text")
    if loose.select("doc_id").isEmpty():
        return known
    loose = loose.orderBy(F.xxhash64("text"), "text").withColumn("tie", F.monotonically_increasing_id() + F.lit(_LOOSE))
    return known.unionByName(staged(loose.select("doc_id", "id", "tie", "text"), "suffix-loose"))


def repeated_spans(docs: DataFrame) -> list[DataFrame]:
    """(id, tie, begin, end) of the removed stretches of :func:`placed` rows; stretches may overlap, level by level."""
    texts = docs.select("id", "tie", "text")
    repeated = staged(texts.mapInArrow(_heads, "head bigint").groupBy("head").agg(F.count(F.lit(1)).alias("n"))
                      .where("n > 1").select("head"), "suffix-heads")
    tuples = texts.mapInArrow(_runs, "head bigint, run bigint, id bigint, tie bigint, first int, windows smallint, reach smallint")
    tuples = staged(tuples.join(repeated.hint("shuffle_hash"), "head", "left_semi"), "suffix-runs")
    classes = _classes(tuples)
    spans = [staged(_later(tuples, classes), "suffix-spans")]
    # Rows that repeat id and text give the same tuples, of which one is enough.
    parts = (_differing(tuples, classes).groupBy("id", "tie")
             .agg(F.collect_set(F.struct("first", "windows", "reach")).alias("parts")))           # at most a text's runs
    blocks = texts.join(staged(parts, "suffix-parts"), ["id", "tie"]).select("id", "tie", "text", "parts")
    blocks = staged(blocks.mapInArrow(_blocks, "head bigint, run bigint, id bigint, tie bigint, first int, windows smallint, rests array<bigint>"),
                    "suffix-blocks")
    plain = blocks.drop("rests")
    classes = _classes(plain)
    spans.append(staged(_later(plain, classes), "suffix-spans"))
    windows = staged(_differing(blocks, classes)
                     .select("head", "id", "tie", "first", F.posexplode("rests").alias("k", "window"))
                     .select("head", "window", "id", "tie", (F.col("first") + F.col("k")).alias("at")), "suffix-windows")
    earliest = staged(windows.groupBy("head", "window").agg(F.min(F.struct("id", "tie", "at")).alias("e"), F.count(F.lit(1)).alias("n"))
                      .where("n > 1").select("head", "window", F.col("e.id").alias("id1"), F.col("e.tie").alias("tie1"), F.col("e.at").alias("at1")),
                      "suffix-earliest")
    again = (windows.join(earliest, ["head", "window"]).where("id <> id1 OR tie <> tie1 OR at <> at1")
             .select("id", "tie", F.col("at").alias("begin"), (F.col("at") + LENGTH).alias("end")))
    return [*spans, staged(again, "suffix-spans")]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes (what is left)."""
    texts = placed(docs)
    first, *more = repeated_spans(texts)
    for other in more:
        first = first.unionByName(other)
    spans = staged(first.groupBy("id", "tie").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "suffix-spans")    # at most a text's windows
    return (texts.join(spans, ["id", "tie"], "left").select("doc_id", "text", "spans")
            .mapInArrow(_finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_bytes binary"))
