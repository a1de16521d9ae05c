"""A quality score by a linear-chain conditional random field over lines.

Every line of a text is good or bad. Its features are shares of characters and words of the line itself and of the
lines before and after it; the chain adds how likely one label follows another. The marginals of the
forward-backward pass, weighted by line length, give a document's share of good text; a logistic curve with two
parameters turns that share into the score.

Lines have no labels of their own: in training, the lines of a document carry its label. Training sees at most
``SAMPLE`` labelled documents, the first in the order of a hash of their ids, and at most ``LINES`` lines of each;
it reads features only and maximises the penalised conditional likelihood by gradient steps on the driver. Every other
document is scored whole, in its task; lines of any number are handled in a chunk's common recursion, whose memory grows with
the longest text.

Defined cases: NULL and empty texts are one empty line and get its score; labels that are NULL or neither 0
nor 1 are not used, nor are ids labelled both ways; without labels of both kinds every score is 0.5; rows that repeat are
scored alike; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import shingles
from millrace.llm.common import small, staged

# The training documents, and the lines that they may have together.
SAMPLE, LINES = 4_000, 400_000
STEPS = 150
PENALTY = 1e-3

# Kinds of bytes: other, small letter, capital, digit, blank, sentence mark, other mark, beyond ASCII.
_KIND = np.zeros(256, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, *range(9, 14)]] = 1, 2, 3, 4
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 5
_KIND[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_KIND[128:] = 7
_KINDS = 8

_OWN = 14
FEATURES = 3 * _OWN + 3


def _shares(top: np.ndarray, below: np.ndarray) -> np.ndarray:
    return top / np.maximum(below, 1)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines in order, number of lines of each text, bytes of each line)."""
    lines = [line for text in texts for line in text.split(b"\n")]
    counts = np.array([text.count(b"\n") + 1 for text in texts])
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    sizes = np.array([len(line) for line in lines])
    n = len(lines)
    owner = np.repeat(np.arange(n), sizes + 1)
    kinds = np.bincount(owner * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    kinds[:, 4] -= 1                                        # the line's own end
    words, n_words = shingles.word_hashes(lines, lower=False)
    line_of = np.repeat(np.arange(n), n_words)
    same_line = line_of[1:] == line_of[:-1]
    again = np.bincount(line_of[1:][same_line & (words[1:] == words[:-1])], minlength=n)
    text_of = np.repeat(np.arange(len(texts)), counts)
    # Words of the line that the text holds elsewhere too, right behind the same word.
    pair = shingles.mixed(shingles.mixed(words[:-1], 31) + words[1:], 32) + text_of[line_of[1:]].astype(np.uint64)
    order = np.argsort(pair)
    twice = np.zeros(len(pair), bool)
    equal = pair[order][1:] == pair[order][:-1]
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    repeated = np.bincount(line_of[1:][twice & same_line], minlength=n)
    # Words that end in a mark other than a sentence's, or are nothing but marks.
    mark = np.isin(_KIND[data], (6,))
    last = np.concatenate((_KIND[data][1:] == 4, [True]))
    marked = np.bincount(owner[mark & last], minlength=n)
    filled = sizes - kinds[:, 4]
    own = np.stack([
        *(_shares(kinds[:, k], filled) for k in (1, 2, 3, 5, 6, 7)),
        _shares(marked, n_words), _shares(again, n_words), _shares(repeated, n_words),
        _shares(kinds[:, 2], kinds[:, 1] + kinds[:, 2]),
        np.log1p(sizes) / 8, np.log1p(n_words) / 8, np.minimum(_shares(filled, n_words), 40) / 10,
        (n_words == 0).astype(float)], axis=1)
    first = np.cumsum(counts) - counts
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    is_first[first], is_last[first + counts - 1] = True, True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[is_first], after[is_last] = 0, 0
    return np.hstack([own, before, after, is_first[:, None], is_last[:, None], np.ones((n, 1))]), counts, sizes


@dataclass(frozen=True)
class Field:
    """``weights`` score a good line against a bad one, ``moves[a, b]`` label b after label a; then the score's curve."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float
    shift: float

    def marginals(self, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chance of good for each line, expected moves of all chains, log of each chain's total)."""
        return _forward_backward(features @ self.weights, self.moves, counts)


def _forward_backward(gain: np.ndarray, moves: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All chains at once, place by place: the k-th lines of all chains that have one."""
    n = len(gain)
    order = np.argsort(-counts, kind="stable")              # longest chains first, so those still running are a prefix
    first = (np.cumsum(counts) - counts)[order]
    running = counts[order]
    longest = int(running[0]) if len(running) else 0
    alive = np.searchsorted(-running, -np.arange(longest), side="left")
    local = np.stack([np.zeros(n), gain], axis=1)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    for k in range(longest):
        at = first[:alive[k]] + k
        ahead[at] = local[at]
        if k:
            ahead[at] += np.logaddexp(ahead[at - 1][:, :1] + moves[0], ahead[at - 1][:, 1:] + moves[1])
    expected = np.zeros((2, 2))
    total = np.zeros(len(counts))
    ends = first + running - 1
    total[order] = np.logaddexp(ahead[ends, 0], ahead[ends, 1]) if n else 0
    for k in range(longest - 2, -1, -1):
        at = first[:alive[k + 1]] + k
        onward = local[at + 1] + back[at + 1]
        joint = ahead[at][:, :, None] + moves[None] + onward[:, None, :] - total[order[:len(at)]][:, None, None]
        expected += np.exp(joint).sum(axis=0)
        back[at] = np.logaddexp(moves[:, 0][None] + onward[:, :1], moves[:, 1][None] + onward[:, 1:])
    both = ahead + back
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700))), expected, total


def document_share(good: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each document's share of good text; a line weighs its bytes and one more."""
    ends = np.cumsum(counts)
    def sums(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(values)))
        return total[ends] - total[ends - counts]
    return sums(good * (sizes + 1)) / np.maximum(sums(sizes + 1.0), 1)


def _adam(value, theta: np.ndarray, steps: int, rate: float) -> np.ndarray:
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        slope = value(theta)
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope ** 2
        theta = theta + rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.99 ** step)) + 1e-9)
    return theta


def fit(features: np.ndarray, counts: np.ndarray, sizes: np.ndarray, labels: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """The field under which the documents' labels, given to all their lines, are likeliest; both kinds weigh the same."""
    if len(set(labels.tolist())) < 2:
        return Field(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, 0.0)
    parts = [(labels == k) for k in (0, 1)]
    chains = np.repeat(labels, counts)
    rows = [features[chains == k] for k in (0, 1)]
    own = [counts[p] for p in parts]

    def slope(theta: np.ndarray) -> np.ndarray:
        weights, moves = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        out = -penalty * theta
        for k in (0, 1):
            good, expected, _ = _forward_backward(rows[k] @ weights, moves, own[k])
            seen = np.zeros((2, 2))
            seen[k, k] = (own[k] - 1).sum()
            weight = 1 / max(int(own[k].sum()), 1)
            out[:FEATURES] += weight * (rows[k].T @ (k - good))
            out[FEATURES:] += weight * (seen - expected).ravel()
        return out

    theta = _adam(slope, np.zeros(FEATURES + 4), steps, 0.1)
    field = Field(theta[:FEATURES], theta[FEATURES:].reshape(2, 2), 0.0, 0.0)
    share = document_share(field.marginals(features, counts)[0], counts, sizes)
    even = np.where(labels == 1, 1 / parts[1].sum(), 1 / parts[0].sum())
    inputs = np.stack([share, np.ones_like(share)], axis=1)

    def curve(theta: np.ndarray) -> np.ndarray:
        chance = 1 / (1 + np.exp(-np.clip(inputs @ theta, -500, 500)))
        return inputs.T @ (even * (labels - chance)) - 1e-3 * theta

    bend = _adam(curve, np.zeros(2), 600, 0.1)
    return Field(field.weights, field.moves, float(bend[0]), float(bend[1]))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in shingles.text_chunks(batch.column(0)):
            features, counts, sizes = line_features(texts)
            cuts = np.cumsum(counts)[:-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(a, b - a),
                 pa.array([f.astype(np.float32).tobytes() for f in np.split(features, cuts)], pa.binary()),
                 pa.array([s.astype(np.int64).tobytes() for s in np.split(sizes, cuts)], pa.binary())],
                names=["quality", "features", "sizes"])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> Field:
    """A field from whole texts of labelled documents of the training folds, in hash order, half of each kind where there are so many.

    At most ``sample`` documents, and of each kind as many as have ``lines`` / 2 lines together. Of rows that repeat an id the text with the smallest hash counts.
    """
    known = (labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.min("quality").alias("quality"), F.max("quality").alias("top")).where("quality = top")
             .where(~held_out()).select("doc_id", "quality", F.xxhash64("doc_id").alias("drawn")))
    chosen = [known.where(F.col("quality") == k).orderBy("drawn", "doc_id").limit(sample // 2) for k in (0, 1)]
    chosen = staged(chosen[0].unionByName(chosen[1]), "crf-sample")
    text = F.col("text").cast("string")
    texts = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).join(small(chosen), "doc_id")
             .groupBy("doc_id", "quality", "drawn").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    texts = staged(texts, "crf-texts")                       # ``sample`` rows at most
    upto = F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1).over(
        Window.partitionBy("quality").orderBy("drawn", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = (texts.withColumn("upto", upto).where(F.col("upto") <= lines // 2).select("text", "quality")
            .mapInArrow(_sample_features, "quality int, features binary, sizes binary")
            .sort("features", "quality").collect())          # the order fixes the sums
    if not rows:
        return fit(np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))
    features = np.concatenate([np.frombuffer(r.features, np.float32).reshape(-1, FEATURES) for r in rows]).astype(float)
    sizes = [np.frombuffer(r.sizes, np.int64) for r in rows]
    return fit(features, np.array([len(s) for s in sizes]), np.concatenate(sizes), np.array([r.quality for r in rows]))


def _score(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in shingles.text_chunks(batch.column(1)):
                features, counts, sizes = line_features(texts)
                good, _, _ = field.marginals(features, counts)
                share = document_share(good, counts, sizes)
                score = 1 / (1 + np.exp(-np.clip(field.slope * share + field.shift, -500, 500)))
                lines_good = np.add.reduceat((good >= 0.5).astype(np.int64), np.cumsum(counts) - counts)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(score), pa.array(counts.astype(np.int64)), pa.array(lines_good)],
                                                 names=["doc_id", "score", "n_lines", "n_good_lines"])

    return run


def score(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document: doc_id, score, predicted, n_lines, n_good_lines."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_score(field), "doc_id bigint, score double, n_lines bigint, n_good_lines bigint")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "n_good_lines")
