"""Alignment of two tokenizers over the same texts, by interval coalescing.

Both tokenizations of a text tile the same bytes (a space and the text). The tokens of a batch of texts, A's and B's
together, are sorted by their first byte; a running maximum of their ends tells where no token reaches over: there a
new group begins, so a group is a smallest stretch that both tile with whole tokens. Overlaps are then expanded, from
each A token to the run of B tokens that share bytes with it. Everything about one batch is done on whole arrays.

Corpus-wide, every pair of ids is counted over all links. A batch gives one row per text and pair; these are summed by
Spark (partial sums first, so a pair that is in every text is one row per task). The counts go back to the texts by a
broadcast of the most frequent pairs, at most ``HOT_PAIRS`` of them; the rest, none of which can be frequent, by a join
on the pair. Both ways give the same numbers, whatever the split.

Defined cases: a text that is NULL, empty, no valid UTF-8, or that one of the tokenizers does not give back byte by byte, has no
tokens: zeros and an empty string. Rows are told apart by place, so repeated rows, repeated ids and NULL ids are texts of
their own (each counts in the corpus). An empty table gives an empty result. Other columns are not looked at. A task's
memory is some two hundred times its longest text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import staged
from millrace.llm.shingles import text_chunks

# Pairs that are sent to every executor: a hash table of some 50 MB.
HOT_PAIRS = 500_000
# Ids that are kept with their words, and the longest such word; the number may be exceeded by the words of one batch.
REMEMBERED, LONGEST_REMEMBERED = 3_000_000, 64
# Characters of new words that are coded at once.
TOGETHER = 1 << 14
# A word begins with the space that follows a character other than white space.
_WORDS = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+").findall
_ODD_BLANK = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search

_SPACE = "▁"
_TEXT = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
         "pairs array<struct<key: bigint, n: int>>")


def byte_of_letter() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes are themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Coders:
    """Both tokenizers, by words that are coded only once, and the bytes of all their tokens.

    A text is cut where a space follows a character that is no white space, unless a vocabulary may join what such a cut divides: A must be a
    byte-level tokenizer whose own pattern divides texts there, and no piece of B may have a space behind another character. White
    space beyond ASCII, on whose kind the two may disagree, keeps a text whole.
    """

    def __init__(self, vocabulary: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabulary)
        self.a.encode_special_tokens = True
        described = json.loads(vocabulary)
        pre = described.get("pre_tokenizer") or {}
        divides = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not described.get("normalizer")
        letters = byte_of_letter()
        a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, number in self.a.get_vocab(with_added_tokens=False).items():
            a_bytes[number] = bytes(letters[c] for c in token) if letters.keys() >= set(token) else b""

        self.b = SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else b"" if self.b.is_control(k) or self.b.is_unknown(k)
                   else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.lone = [self.b.piece_to_id(_SPACE)]
        self.by_words = divides and not any(_SPACE in p.lstrip(_SPACE) for p in pieces)

        self.token_bytes = (a_bytes, b_bytes)
        self.lengths = [np.array([len(t) for t in side], np.int64) for side in self.token_bytes]
        # An id with what stands before it in a group's text: another token of its side, a new group, or the other side.
        self.width = max(map(len, self.lengths))
        self.texts = np.array([f"{mark}{k}" for mark in ",;|" for k in range(self.width)], object)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        # Of all words known: their ids end to end, how many each has, and whether these give the word's bytes back.
        self.flat = [np.zeros(0, np.int32)] * 2
        self.sizes = [np.zeros(0, np.int64)] * 2
        self.good = np.zeros(0, bool)

    def _coded(self, text: str) -> list[np.ndarray]:
        """Ids of a text that begins with a space. B puts that there itself - but not before nothing."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.b.encode(text[1:]) if text != " " else self.lone
        return [np.array(a, np.int32), np.array(b, np.int32)]

    def _same(self, side: int, ids: np.ndarray, whole: bytes) -> bool:
        return b"".join(map(self.token_bytes[side].__getitem__, ids.tolist())) == whole

    def _together(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids and numbers of ids of words that may stand one behind the other, and which of them are given back."""
        whole = "".join(words)
        ids, encoded = self._coded(whole), whole.encode()
        if not all(self._same(side, ids[side], encoded) for side in (0, 1)):
            if len(words) == 1:
                return ids, [np.array([len(i)]) for i in ids], np.zeros(1, bool)
            parts = [self._together([w]) for w in words]
            return ([np.concatenate([p[0][side] for p in parts]) for side in (0, 1)], [np.concatenate([p[1][side] for p in parts]) for side in (0, 1)],
                    np.concatenate([p[2] for p in parts]))
        ends = np.cumsum([len(w.encode()) for w in words])
        sizes = [np.diff(np.searchsorted(np.cumsum(length[i]), ends, "right"), prepend=0) for length, i in zip(self.lengths, ids)]
        return ids, sizes, np.ones(len(words), bool)

    def _learn(self, words: list[str]) -> None:
        """Words are coded together where a text of them would be cut between them: if they end in no white space."""
        plain = [w for w in words if self.by_words and not w[-1].isspace() and not _ODD_BLANK(w)]
        size = np.cumsum([len(w) for w in plain]) // TOGETHER
        borders = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(plain)]
        alone = sorted(set(words).difference(plain))
        groups = [plain[s:e] for s, e in zip(borders, borders[1:]) if e > s] + [[w] for w in alone]
        found = [self._together(g) for g in groups]
        self.known.update(zip(chain.from_iterable(groups), range(len(self.good), len(self.good) + len(words))))
        self.good = np.concatenate([self.good, *(f[2] for f in found)])
        for side in (0, 1):
            self.flat[side] = np.concatenate([self.flat[side], *(f[0][side] for f in found)])
            self.sizes[side] = np.concatenate([self.sizes[side], *(f[1][side] for f in found)])

    def code(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of all texts by A and by B, end to end, and their numbers per text; none where bytes are not given back.

        Texts begin with the space that both put before a text."""
        if len(self.flat[0]) > REMEMBERED:
            self._forget()
        words = [_WORDS(t) if self.by_words and not _ODD_BLANK(t) else [t] if t else [] for t in texts]
        new = list(set(chain.from_iterable(words)).difference(self.known))
        self._learn(new)
        counts = np.array([len(w) for w in words], np.int64)
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        for word in new:
            if len(word) > LONGEST_REMEMBERED:
                del self.known[word]
        owner = np.repeat(np.arange(len(texts)), counts)
        bad = np.bincount(owner[~self.good[number]], minlength=len(texts)) > 0
        number, owner = number[~bad[owner]], owner[~bad[owner]]
        ids, sizes = [], []
        for flat, size in zip(self.flat, self.sizes):
            first, n = (np.cumsum(size) - size)[number], size[number]
            ids.append(flat[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)].astype(np.int64))
            sizes.append(np.bincount(owner, n, len(texts)).astype(np.int64))
        return ids, sizes


@lru_cache(maxsize=1)
def coders(vocabulary: str, model: bytes) -> Coders:
    return Coders(vocabulary, model)


def coalesced(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The group of each interval: sorted by start, a group ends where a start reaches the largest end so far."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.zeros(len(starts), np.int64)
    group[order[1:]] = np.cumsum(starts[order][1:] >= reach[:-1])
    return group


def overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all pairs of intervals that share a byte; each side is (starts, ends), ascending, without gaps."""
    first = np.searchsorted(b[1], a[0], "right")
    n = np.searchsorted(b[0], a[1], "left") - first
    left = np.repeat(np.arange(len(n)), n)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def align_texts(coder: Coders, texts: list[bytes]) -> dict[str, list[str] | np.ndarray]:
    """Counts, group texts and pair counts of some texts (UTF-8); the arrays of pairs are laid end to end."""
    n = len(texts)
    whole = [" " + t.decode("utf-8", "replace") if t else "" for t in texts]
    # Bytes that are no UTF-8 have become others.
    whole = ["" if "\ufffd" in w and w.encode() != b" " + t else w for w, t in zip(whole, texts)]
    ids, counts = coder.code(whole)
    # The texts that count are tiled by both without gaps, so places in all of them together agree, too.
    ends = [np.cumsum(length[i]) for length, i in zip(coder.lengths, ids)]
    starts = [e - length[i] for e, length, i in zip(ends, coder.lengths, ids)]
    owner = [np.repeat(np.arange(n), c) for c in counts]
    group = coalesced(np.concatenate(starts), np.concatenate(ends))
    sides = group[:len(ids[0])], group[len(ids[0]):]
    first = np.flatnonzero(np.diff(sides[0], prepend=-1)) if len(group) else np.zeros(0, np.int64)
    n_groups = np.bincount(owner[0][first], minlength=n)
    left, right = overlaps((starts[0], ends[0]), (starts[1], ends[1]))
    n_links = np.bincount(owner[0][left], minlength=n)
    # One number for (text, A id, B id); vocabularies are far below 2^21 and a chunk holds at most 2^20 texts.
    width_a, width_b = map(len, coder.lengths)
    linked, times = np.unique((owner[0][left] * width_a + ids[0][left]) * width_b + ids[1][right], return_counts=True)
    text_of = linked // (width_a * width_b)
    # Stable: within a group A's tokens come before B's, each side in order.
    order = np.argsort(group, kind="stable")
    is_b, all_ids, ordered = order >= len(ids[0]), np.concatenate(ids)[order], group[order]
    mark = np.zeros(len(order), np.int64)
    mark[1:][is_b[1:] & ~is_b[:-1]] = 2
    mark[np.flatnonzero(np.diff(ordered, prepend=-1))] = 1
    written = coder.texts[mark * coder.width + all_ids].tolist()
    at = np.cumsum(np.concatenate(([0], counts[0] + counts[1]))).tolist()
    return {"n_a": counts[0], "n_b": counts[1], "n_groups": n_groups, "n_links": n_links,
            "groups": ["".join(written[s:e])[1:] for s, e in zip(at, at[1:])],
            "n_pairs": np.bincount(text_of, minlength=n), "key": linked % (width_a * width_b), "n": times}


def _align(vocabulary: str, model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coders(vocabulary, model)
        for batch in batches:
            for start, end, texts in text_chunks(batch.column(2)):
                found = align_texts(coder, texts)
                offsets = pa.array(np.concatenate(([0], np.cumsum(found["n_pairs"]))), pa.int32())
                pairs = pa.StructArray.from_arrays([pa.array(found["key"], pa.int64()), pa.array(found["n"], pa.int32())], names=["key", "n"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start),
                     *(pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                     pa.array(found["groups"], pa.string()), pa.ListArray.from_arrays(offsets, pairs)],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    return run


def _most_frequent(counted: DataFrame, most: int) -> int:
    """The smallest power of two so that at most ``most`` pairs are counted that often or more (1: all of them)."""
    sizes = {r["bits"]: r["pairs"] for r in counted.groupBy(F.length(F.bin("total")).alias("bits")).agg(F.count(F.lit(1)).alias("pairs")).collect()}
    seen, least = 0, 1 << 62
    for bits in sorted(sizes, reverse=True):
        seen += sizes[bits]
        if seen > most:
            return least
        least = 1 << (bits - 1)
    return 1


def align(docs: DataFrame, vocabulary_file: str, model_file: str, id_column: str = "doc_id", text_column: str = "text",
          digest: bool = False, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups``.

    ``groups`` is the alignment itself, as text: the ids of each group's tokens, ``a1,a2|b1;a3|b2,b3``. With ``digest`` its SHA-256
    stands there instead ('' without tokens) and the text is written nowhere. The driver reads both files; they go with the tasks.
    """
    with open(vocabulary_file, encoding="utf-8") as file:
        vocabulary = file.read()
    with open(model_file, "rb") as file:
        model = file.read()
    width_b = len(coders(vocabulary, model).lengths[1])
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
                        F.col(f"`{text_column}`").cast("string").alias("text"))
    aligned = texts.mapInArrow(_align(vocabulary, model), _TEXT)
    if digest:
        aligned = aligned.withColumn("groups", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit("")))
    aligned = staged(aligned, "alignment-texts")
    counted = staged(aligned.select(F.inline("pairs")).groupBy("key").agg(F.sum("n").alias("total")), "alignment-counts")
    # As many rows as B has ids.
    tops = counted.groupBy(F.pmod("key", F.lit(width_b)).alias("b")).agg(F.max("total").alias("top"))
    ranked = (counted.join(F.broadcast(tops), F.pmod("key", F.lit(width_b)) == F.col("b"))
              .select("key", "total", (F.col("total") == F.col("top")).cast("bigint").alias("best")))
    least = _most_frequent(counted, hot_pairs)

    sums = (F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    lines = aligned.select("row", F.inline("pairs"))
    hot = F.broadcast(ranked.where(F.col("total") >= least))
    # A text's pairs lie together, so this is one row per text before anything is shuffled.
    found = lines.join(hot, "key").groupBy("row").agg(*sums)
    if least > 1:
        cold = ranked.where(F.col("total") < least).hint("shuffle_merge")
        rest = lines.join(hot, "key", "left_anti").join(cold, "key").groupBy("row").agg(*sums)
        found = found.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    scored = aligned.drop("pairs").join(found, "row", "left")
    zero = F.lit(0).cast("bigint")
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                         F.coalesce("count_sum", zero).alias("count_sum"), "groups")
