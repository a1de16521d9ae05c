"""Word shingles of many texts at once, as 64-bit hashes in numpy.

Texts are laid end to end as UTF-8 bytes; words are runs of bytes that are not white space, A-Z lower-cased. A word's
hash is the sum of its bytes' random values times random odd numbers of their places, modulo 2^64 (a polynomial would not do:
modulo a power of two there are words that share a hash for every base); a shingle's is a polynomial of its words' mixed hashes. Two
different shingles of one comparison share a hash with a chance of about 2^-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
# Bytes of text that are hashed together; a longer text is a chunk of its own.
CHUNK = 1 << 20

_U = np.uint64
# The multipliers of the splitmix64 mixer.
_M1, _M2, _STEP = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Every value of ``x`` (uint64) through a 64-bit mixer; each seed is another hash function."""
    x = x + _U((seed + 1) * int(_STEP) & _MASK)
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


_LOWER = np.arange(256, dtype=np.uint8)
BYTE_VALUES = mixed(_LOWER.astype(_U), 77)
_LOWER[65:91] += 32
_LOWERED = mixed(_LOWER.astype(_U), 77)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
INVERSE = pow(BASE, -1, 1 << 64)
_TABLES: dict[int, np.ndarray] = {}


def power_table(n: int, base: int) -> np.ndarray:
    table = _TABLES.get(base)
    if table is None or len(table) < n:
        table = _TABLES[base] = _powers(max(n, CHUNK), base)
    return table[:n]


def _multipliers(n: int) -> np.ndarray:
    """A random odd number for each of the first ``n`` places of a word."""
    table = _TABLES.get(0)
    if table is None or len(table) < n:
        table = _TABLES[0] = mixed(np.arange(max(n, 1 << 12), dtype=_U), 78) | _U(1)
    return table


def stretches(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where the values of a text or binary column begin and end, and the bytes they lie in; nothing is copied."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if ends is None or not len(column):
        return np.zeros(len(column) + 1, kind), memoryview(b"")
    ends = np.frombuffer(ends, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize)
    return ends, memoryview(data) if data is not None else memoryview(b"")


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """A text column in ranges of about CHUNK bytes, as UTF-8; NULL is empty. Only one range is copied at a time."""
    ends, data = stretches(column)
    null = column.is_null().to_numpy(zero_copy_only=False)
    start, n = 0, len(column)
    while start < n:
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + CHUNK, "right")) - 1)
        yield start, end, [b"" if null[k] else bytes(data[ends[k]:ends[k + 1]]) for k in range(start, end)]
        start = end


# Letters, digits and everything beyond ASCII are words, all else is between them.
PLAIN = np.ones(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_hashes(texts: list[bytes], lower: bool = True, blanks: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text); A-Z count as a-z if ``lower``."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = blanks[data]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    ends = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    counts = np.diff(np.searchsorted(starts, ends))
    if not len(starts):
        return np.zeros(0, _U), counts
    values = (_LOWERED if lower else BYTE_VALUES)[data]
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(first)
    place[blank] = 0
    values *= _multipliers(int(place.max()) + 1)[place]
    values[blank] = 0
    return mixed(np.add.reduceat(values, starts), 5), counts


def shingle_hashes(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of text 0, of text 1, ..., each text's sorted; number of them per text).

    A text with fewer words than ``width`` has its whole word sequence as one shingle, one without words none.
    """
    words, counts = word_hashes(texts)
    if not len(words):
        return words, counts
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    place = np.arange(len(words)) - first
    left = np.repeat(counts, counts) - place
    short = np.repeat(counts, counts) < width
    heads = np.flatnonzero((left >= width) | (short & (place == 0)))
    padded = np.concatenate((words, np.zeros(width, _U)))
    value = np.zeros(len(heads), _U)
    room = left[heads]
    for k in range(width):
        value = value * _U(BASE) + np.where(room > k, padded[heads + k], _U(0))
    value = mixed(value ^ np.minimum(room, width).astype(_U), 11)
    owner = owner[heads]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.bincount(owner, minlength=len(texts))
