"""Licence scan: winnowed fingerprints find candidate templates, banded alignment says what is covered and where.

Words are runs of letters and digits, lower-cased. Of every ``WINDOW`` consecutive word pairs the one with the
smallest hash is a fingerprint, in templates and texts alike, so any shared run of ``WINDOW + 1`` words shares
one. The templates' fingerprints form an inverted index (fixed size, sent to every task). A text's hits are
gathered by template and diagonal into places; there the template is aligned with the text within ``BAND``
words of the hits' diagonals, so inserted, missing and changed words are allowed - but for the words that tell licences apart (names, numbers of
versions, terms such as ND): the matched stretch, with the rest of a version number behind it, must have the template's and no others.
A short notice with a negation within the three words before it names no licence. Of matches that overlap, the one with more matched words stays (then more
coverage, then the earlier name).

Defined cases: NULL and empty texts have no matches; a template that occurs twice is two matches; rows that repeat
are scanned alike; an empty table gives an empty result; other columns are not looked at. Offsets are code
points of the text. A task's memory is some twenty times its longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shingles
from millrace.llm.license_texts import NEGATIONS, NOTICES, TELLING, VERSION_MARKS

WINDOW = 3
BAND = 12
LEAST_COVERAGE = 0.8
# Templates of at most so many words only name a licence; a negation before them counts.
NAMING = 24

_WORDS = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
MATCH = "array<struct<license: string, coverage: double, matched: int, start: int, end: int>>"


def fingerprints(words: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """(position, hash) columns of the winnowed word pairs of all texts; a text of fewer pairs gives its smallest."""
    if len(words) < 2:
        return np.zeros((0, 2), np.uint64)
    pairs = shingles.mixed(shingles.mixed(words[:-1], 61) + words[1:], 62)
    owner = np.repeat(np.arange(len(counts)), counts)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    pairs[owner[:-1] != owner[1:]] = none
    chosen = np.zeros(len(pairs), bool)
    padded = np.concatenate((pairs, np.full(window - 1, none)))
    spans = np.lib.stride_tricks.sliding_window_view(padded, window)
    least = spans.argmin(axis=1)
    # A window counts if it lies in one text, or begins a text that is shorter than a window.
    ends = np.cumsum(counts)[owner[:-1]]
    at = np.arange(len(pairs))
    begins = (np.cumsum(counts) - counts)[owner[:-1]] == at
    whole = at + window < ends
    good = (whole | begins) & (spans.min(axis=1) != none)
    chosen[(at + least)[good]] = True
    place = np.flatnonzero(chosen)
    return np.stack([place.astype(np.uint64), pairs[place]], axis=1)


@dataclass(frozen=True)
class Index:
    names: list[str]
    words: list[np.ndarray]
    hashes: np.ndarray                     # sorted, one per entry
    entries: np.ndarray                    # (template, position) of each
    telling: list[frozenset[str]]          # of each template, the words that tell it from others
    needs: list[list[frozenset[int]]]      # of each such word, the hashes of the forms it may have in a text

    @classmethod
    def of(cls, templates: dict[str, str]) -> Index:
        names = sorted(templates)
        words, telling, needs, hashes, entries = [], [], [], [], []
        for number, name in enumerate(names):
            own, counts = shingles.word_hashes([templates[name].encode()], blanks=shingles.PLAIN)
            words.append(own)
            telling.append(_telling(_WORDS.findall(templates[name])))
            needs.append([frozenset(_hash(form) for form in ({w, f"v{w}"} if w.isdigit() else {w})) for w in telling[-1]])
            for place, value in fingerprints(own, counts):
                hashes.append(value)
                entries.append((number, int(place)))
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        return cls(names, words, np.array(hashes, np.uint64)[order], np.array(entries)[order], telling, needs)


def _telling(words: list[str]) -> frozenset[str]:
    """The words that tell licences apart, and numbers that follow one of them, a version's mark or another such number; zeros say nothing."""
    found, counts = set(), False
    for word in (w.lower() for w in words):
        number = word[1:] if word[:1] == "v" else word
        if word in TELLING:
            found.add(word)
            counts = True
        elif number.isdigit() and len(number) < 3 and (counts or word != number):
            found.add(number)
            counts = True
        else:
            counts = word in VERSION_MARKS
    return frozenset(found - {"0"})


def _hash(word: str) -> int:
    return int(shingles.word_hashes([word.encode()], blanks=shingles.PLAIN)[0][0])


def _may_be(words: np.ndarray, template: int, hits: list[tuple[int, int]], index: Index) -> bool:
    """Whether all that tells the template apart stands around the hits: cheaper than an alignment, and it leaves few of many alike."""
    reach = len(index.words[template]) + 2 * BAND
    places = [place for _, place in hits]
    there = set(words[max(0, min(places) - reach):max(places) + reach].tolist())
    return all(not there.isdisjoint(forms) for forms in index.needs[template])


def _is_it(text: str, spans: list[tuple[int, int]], first: int, last: int, template: int, index: Index) -> bool:
    """Whether the words ``first`` to ``last`` of a text name the template's licence and no neighbour of it."""
    def word(k: int) -> str:
        return text[slice(*spans[k])].lower()

    # A version number goes on behind the match: "version 2" of "version 2.1"; a zero there changes nothing.
    end = last
    while end + 1 < len(spans) and word(end).isdigit() and word(end + 1).isdigit() and text[spans[end][1]:spans[end + 1][0]] == ".":
        end += 1
    words = [word(k) for k in range(first, end + 1)]
    there, wanted = _telling(words), index.telling[template]
    # Names must be the same; a number of the template may have lost the word before it.
    if there - wanted or wanted - there - {w for w in words if w.isdigit()}:
        return False
    return len(index.words[template]) > NAMING or not any(word(k) in NEGATIONS for k in range(max(0, first - 3), first))


def align(template: np.ndarray, text: np.ndarray, low: int, high: int, begin: int, end: int) -> tuple[int, int, int]:
    """(matched words, first, last) of the best alignment of ``template`` in ``text[begin:end]`` (word hashes) whose
    diagonals (text position less template position) lie from ``low`` to ``high``. Equal words gain 2, a gap or a change costs 1."""
    width = high - low + 1
    # Per cell: score, matched words, text position of the first match, of the last.
    above = [(0, 0, -1, -1)] * (width + 1)
    best = (0, 0, -1, -1)
    for i in range(len(template)):
        row: list[tuple[int, int, int, int]] = []
        left = (0, 0, -1, -1)
        for d in range(width):
            j = i + low + d
            cell = (0, 0, -1, -1)
            if begin <= j < end:
                score, matched, first, last = above[d]
                if template[i] == text[j]:
                    cell = (score + 2, matched + 1, first if first >= 0 else j, j)
                elif score > 1:
                    cell = (score - 1, matched, first, last)
                for other in (left, above[d + 1]):
                    if other[0] - 1 > cell[0]:
                        cell = (other[0] - 1, *other[1:])
                if cell > best and cell[1] >= best[1]:
                    best = cell
            row.append(cell)
            left = cell
        above = [*row, (0, 0, -1, -1)]
    return best[1], best[2], best[3]


def _places(hits: list[tuple[int, int, int]], lengths: list[int]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Hits (template, diagonal, text position) by template, cut where diagonals lie more than a band apart or spread
    over more than the template's length: (template, its (diagonal, text position) pairs)."""
    template, own = None, []
    for at, diagonal, place in sorted(hits):
        if own and (at != template or diagonal > own[-1][0] + BAND or diagonal > own[0][0] + lengths[at]):
            yield template, own
            own = []
        template = at
        own.append((diagonal, place))
    if own:
        yield template, own


def matches(text: str, words: np.ndarray, hits: list[tuple[int, int, int]], index: Index, least: float) -> list[dict]:
    found = []
    spans: list[tuple[int, int]] | None = None
    for template, own in _places(hits, [len(w) for w in index.words]):
        wanted = index.words[template]
        if not _may_be(words, template, own, index):
            continue
        open_parts = [(own, 0, len(words))]              # hits, and the part of the text they may match in
        while open_parts:
            part, begin, end = open_parts.pop()
            matched, first, last = align(wanted, words, min(part)[0] - BAND, max(part)[0] + BAND, begin, end)
            if matched and matched >= least * len(wanted):
                spans = spans or [m.span() for m in _WORDS.finditer(text)]
                if _is_it(text, spans, first, last, template, index):
                    found.append((-matched, -matched / len(wanted), index.names[template], first, last))
                sides = ([h for h in part if h[1] < first], begin, first), ([h for h in part if h[1] > last], last + 1, end)
                open_parts += [side for side in sides if side[0]]
    kept: list[tuple] = []
    for item in sorted(found):
        if all(item[4] < other[3] or item[3] > other[4] for other in kept):
            kept.append(item)
    if not kept:
        return []
    return [{"license": name, "coverage": -share, "matched": -matched, "start": spans[first][0], "end": spans[last][1]}
            for matched, share, name, first, last in sorted(kept, key=lambda k: k[3])]


def scan_texts(column: pa.Array, index: Index, least: float = LEAST_COVERAGE) -> list[list[dict]]:
    """The matches of each text of a column."""
    out: list[list[dict]] = [[] for _ in range(len(column))]
    for a, _, texts in shingles.text_chunks(column):
        words, counts = shingles.word_hashes(texts, blanks=shingles.PLAIN)
        prints = fingerprints(words, counts)
        low = np.searchsorted(index.hashes, prints[:, 1], "left")
        hit = np.flatnonzero((low < len(index.hashes)) & (index.hashes[np.minimum(low, len(index.hashes) - 1)] == prints[:, 1]))
        starts = np.cumsum(counts) - counts
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for k in hit:
            text = int(np.searchsorted(starts + counts, prints[k, 0], "right"))
            place = int(prints[k, 0]) - int(starts[text])
            for entry in range(low[k], np.searchsorted(index.hashes, prints[k, 1], "right")):
                template, position = index.entries[entry]
                hits.setdefault(text, []).append((int(template), place - int(position), place))
        for text, own in hits.items():
            out[a + text] = matches(texts[text].decode(), words[starts[text]:starts[text] + counts[text]], own, index, least)
    return out


def scan(docs: DataFrame, templates: dict[str, str] = NOTICES, least: float = LEAST_COVERAGE) -> DataFrame:
    """One row per document: doc_id and its matches in text order (license, coverage, matched words, start, end)."""
    index = Index.of(templates)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()),
                               ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scan_texts(batch.column(1), index, least)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "matches"])

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, f"doc_id bigint, matches {MATCH}"))
