"""Quality rules: countable faults of a text, and how much it reads like trusted text.

The second is a log-likelihood ratio of two multinomials over hashed byte 4-grams: one counted on trusted documents
(labelled good), one on the whole raw corpus. A text's score is the mean ratio per 4-gram, in whole millionths per
4-gram, so sums are exact and the same in any order; a text below ``LEAST`` is rejected. Both counts cover every whole
text. Up to ``TRUSTED`` ids labelled good are sent to the tasks, so that no text is shuffled to meet its label; more are joined. What is sent
to the tasks afterwards is one number per hash bucket, of which there are always ``BUCKETS``; no document's 4-gram crosses into the next one.

Defined cases: NULL text has no words, lines or 4-grams and fails the base rules; a text of fewer than four bytes
scores 0; without any trusted document all scores are 0; a document is trusted if any row
of ``labels`` says so, whatever the others say, NULLs do not; rows that repeat are judged alike; an empty table gives an
empty result. Other columns are not looked at. A task's memory is some twenty times its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shingles
from millrace.llm.common import staged

BITS = 16
BUCKETS = 1 << BITS
GRAM = 4
SMOOTHING = 10.0             # pseudo-count of every bucket, so that a rare 4-gram says little either way
# Trusted ids up to this many are sent to every executor; more of them are joined with the texts, which are shuffled then.
TRUSTED = 1_000_000
# A text must score at least this many millionths per 4-gram: it is rejected where raw text explains it better by half a nat each.
LEAST = -500_000
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
# Fixed values of the rules: the characters that count as symbols, and the multiplier of the bucket hash (2^32 / golden ratio).
SYMBOLS = b"[#*$%&|<>]"[1:-1]
_SPREAD = np.uint32(0x9E3779B1)
_BLANK = " \t\n\x0b\x0c\r"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, *range(9, 14), *range(0x80, 0xC0)]] = False     # not blank, and no continuation byte

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), ends - [len(t) for t in texts], ends


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[ends] - total[starts]


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the 4-gram that starts at each byte but the last three."""
    grams = np.ndarray(max(len(data) - GRAM + 1, 0), "<u4", data, strides=(1,)) if len(data) >= GRAM else np.zeros(0, "<u4")
    return (grams * _SPREAD) >> np.uint32(32 - BITS)


def _gram_counts(texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(BUCKETS, np.int64)
    data, starts, ends = _laid_out(texts)
    at = gram_buckets(data).astype(np.int64)
    across = (ends[:, None] - np.arange(GRAM)[None, :]).ravel()           # starts whose 4 bytes reach past the end
    at[np.unique(across[(across >= 0) & (across < len(at))])] = BUCKETS
    for i in np.flatnonzero(ends - starts < GRAM):
        at[starts[i]:ends[i] + 1] = BUCKETS
    return np.bincount(at, minlength=BUCKETS + 1)[:BUCKETS]


def repeated_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, the words inside 3-word windows that the text holds twice or more."""
    ends = np.cumsum(counts)
    if len(words) < 3:
        return np.zeros(len(counts), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    mix = shingles.mixed
    window = mix(mix(mix(words[:-2], 21) + words[1:-1], 22) + words[2:], 23)
    window = mix(window + owner[:-2].astype(np.uint64), 24)
    inside = owner[:-2] == owner[2:]
    at = np.flatnonzero(inside)
    order = at[np.argsort(window[at])]
    ranked = window[order]
    twice = np.zeros(len(ranked), bool)
    equal = ranked[1:] == ranked[:-1]
    twice[1:] |= equal
    twice[:-1] |= equal
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[order[twice] + k] = True
    return _sums(covered, ends - counts, ends)


def measure(texts: list[bytes]) -> np.ndarray:
    """The columns of ``_COUNTS`` for each text."""
    data, starts, ends = _laid_out(texts)
    words, n_words = shingles.word_hashes(texts, lower=False)
    dup_lines = []
    for text in texts:
        lines = [line for line in text.split(b"\n") if line.strip(_BLANK.encode())] if b"\n" in text else ()
        dup_lines.append(len(lines) - len(set(lines)))
    return np.stack([n_words, _sums(_IN_WORD[data], starts, ends), _sums(_IS_SYMBOL[data], starts, ends),
                     np.array(dup_lines, np.int64), repeated_words(words, n_words)], axis=1)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, texts in shingles.text_chunks(batch.column(0)):
            counts += _gram_counts(texts)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])


def gram_weights(docs: DataFrame, labels: DataFrame, most: int = TRUSTED) -> np.ndarray:
    """The log-likelihood ratio of each bucket in millionths, from every whole text of ``docs`` and every trusted one among them."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("good_id")).distinct()
    good = staged(good, "rules-trusted")
    few = good.limit(most + 1).count() <= most
    trusted = docs.join(F.broadcast(good) if few else good.hint("merge"), F.col("doc_id") == F.col("good_id"))

    def counted(texts: DataFrame, of: int) -> DataFrame:
        return (texts.select("text").mapInArrow(_count_grams, "bucket bigint, n bigint")
                .groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("of", F.lit(of)))

    counts = np.zeros((2, BUCKETS))
    for row in counted(trusted, 0).unionByName(counted(docs, 1)).collect():          # at most 2 * BUCKETS rows
        counts[row.of, row.bucket] = row.n
    if not counts[0].any():
        return np.zeros(BUCKETS, np.int64)
    # Trusted counts at the corpus' scale, so that the same pseudo-count draws both multinomials to the same point.
    scaled = counts[0] * (counts[1].sum() / counts[0].sum())
    return np.rint(1e6 * (np.log(scaled + SMOOTHING) - np.log(counts[1] + SMOOTHING))).astype(np.int64)


def _judged(column: pa.Array, weights: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts of a column in ranges: (begin, end, counts, sum of the 4-grams' ratios, number of 4-grams)."""
    for a, b, texts in shingles.text_chunks(column):
        data, starts, ends = _laid_out(texts)
        grams = np.maximum(ends - starts - GRAM + 1, 0)
        gains = weights[gram_buckets(data)]
        first = np.minimum(starts, len(gains))          # a short last text starts behind the last 4-gram
        yield a, b, measure(texts), _sums(gains, first, first + grams), grams


def _judge(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, counts, ratio, grams in _judged(batch.column(1), weights):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), *(pa.array(c) for c in counts.T), pa.array(ratio), pa.array(grams)],
                    names=["doc_id", *_COUNTS, "ratio_sum", "n_grams"])

    return run


def _keep(weights: np.ndarray, text_at: int, least: int):
    """Whole rows, those that pass; the same decision as in :func:`rules`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_at)
            if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
                column = column.cast(pa.string())
            for a, b, counts, ratio, grams in _judged(column, weights):
                n_words, repeated = counts[:, _COUNTS.index("n_words")], counts[:, _COUNTS.index("n_repeat_words")]
                failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n_words)
                yield batch.slice(a, b - a).filter(pa.array(~failed & (ratio >= least * grams)))

    return run


def rules(docs: DataFrame, labels: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, then the ratio's sum and number of 4-grams."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weights = gram_weights(texts, labels)
    schema = ", ".join(f"{c} bigint" for c in ["doc_id", *_COUNTS, "ratio_sum", "n_grams"])
    judged = texts.mapInArrow(_judge(weights), schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    kept = ~failed & (F.col("ratio_sum") >= least * F.col("n_grams"))
    return judged.select("doc_id", *_COUNTS, failed.alias("base_failed"), kept.alias("kept"), "ratio_sum", "n_grams")


def keep_good(docs: DataFrame, labels: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows that pass, with all columns as they were. Every row is judged by its own text, whatever others share its id."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_keep(gram_weights(texts, labels), docs.columns.index("text"), least), docs.schema)
