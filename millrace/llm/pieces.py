"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is a lattice of boundaries between characters; pieces are its edges. The search goes over the
boundaries from left to right and keeps for each one the best edge that ends there:

- *unigram* models: the edge with which the sum of scores is greatest;
- *BPE* models: the edge that the merges would leave there. The merges of a prefix end in exactly one piece,
  and a sequence is what merging gives if and only if each neighbouring pair is: an edge survives if
  merging its text together with the piece before it gives these two pieces back.

Only boundaries within one maximum piece length of the front can be extended, so only these are kept. As soon
as the paths back from all of them run through one boundary, the pieces before it are final and are committed.
Where no piece of the model joins two characters - before the blank mark and between scripts, in most models - every path runs
through the boundary between them; the text is cut there first, and short cuts are looked up.

Edges without a piece (one unknown character) become bytes if the model has byte pieces, else the unknown id.
Decoding joins pieces, turns byte pieces into text (a byte that is not UTF-8 gives U+FFFD) and marks into
blanks. Text with a literal U+2581 decodes with a blank in its place, as the model cannot tell the two apart.

Defined cases: NULL gives NULL, an empty text no ids; texts of any length need memory for their ids only;
repeated rows are coded alike; the columns of the input stay, in front of the new ones, which replace input
columns of the same names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
# Cuts up to this many characters are looked up; so many of them, and so many pairs, are remembered by one worker.
REMEMBERED_CHARS = 48
REMEMBERED = 1 << 17
REMEMBERED_PAIRS = 1 << 18
# Smaller scripts are not cut from each other.
SCRIPT_CHARS = 16
# Kinds of pieces and of models in the file format, and what an unknown character costs a unigram model.
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


class _Cuts(dict):
    """Ids of the cuts seen so far; the others are searched. Full, it keeps what was looked up since it last was."""

    def __init__(self, search):
        super().__init__()
        self.search = search
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, cut: str) -> tuple[int, ...]:
        ids = self.older.get(cut)
        if ids is None:
            ids = self.search(cut)
            if len(cut) > REMEMBERED_CHARS:
                return ids
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[cut] = ids
        return ids


class Pieces:
    """A piece model: its vocabulary, and the search over it. Pieces are numbered by their ids; two more numbers stand
    for the start of a text and for an unknown character."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True):
        if any(k in (USER_DEFINED, UNUSED) for _, _, k in pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.bpe = kind == BPE
        self.dummy_prefix = dummy_prefix
        self.names = [p for p, _, _ in pieces]
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.scores = {p: s for p, s, k in pieces if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.unknown_score = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids), default=1)
        self.begin, self.stray = len(pieces), len(pieces) + 1
        self.lengths = [len(p) for p in self.names] + [0, 1]
        # When a piece is merged: single characters are there from the start, then by score.
        self.turn = {p: n for n, p in enumerate(sorted(self.ids, key=lambda p: (len(p) > 1, -self.scores[p], self.ids[p])))}
        self.backward: dict = {}                    # the pieces as a tree, read from their ends; 0 marks a whole piece
        for p, i in self.ids.items():
            node = self.backward
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[0] = i
        self._after: list[dict[int, bool]] = [{} for _ in range(self.stray + 1)]      # for each piece: what it may follow, as far as asked
        self._asked = 0
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p), self._after[i]))
        self.automaton.make_automaton()
        self.joined = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.cut = self._cut_pattern()
        self.bytes_of = {i: bytes([b]) for b, i in self.byte_ids.items() if b >= 128}
        hidden = {i for i, (_, _, k) in enumerate(pieces) if k not in (NORMAL, BYTE, UNKNOWN)}
        self.text_of = ["" if i in hidden else " ⁇ " if i == self.unknown else p.replace(MARK, " ") for i, p in enumerate(self.names)]
        for b, i in self.byte_ids.items():
            self.text_of[i] = chr(b) if b < 128 else ""
        self._cuts = _Cuts(self._search)
        self._halves: dict[str, tuple[str, str] | None] = {}

    def _cut_pattern(self) -> re.Pattern | None:
        """Where every text may be cut: before marks, around ASCII characters that are in no longer piece, and between scripts:
        large sets of characters that pieces join with one another, but with no character outside but the mark."""
        if any(p[i] != MARK and p[i + 1] == MARK for p in self.ids for i in range(len(p) - 1)):
            return None
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inside)
        scripts = ["".join(map(re.escape, sorted(s))) for s in self._scripts() if len(s) >= SCRIPT_CHARS]
        runs = "|".join([*(f"[{s}]+" for s in scripts), f"[^{MARK}{alone}{''.join(scripts)}]+"])
        return re.compile(f"{MARK}*(?:{runs})|{MARK}+" + (f"|[{alone}]" if alone else ""))

    def _scripts(self) -> list[set[str]]:
        """Sets of characters that pieces join, directly or by way of others; the largest first."""
        script: dict[str, set[str]] = {}
        for a, b in (pair for pair in self.joined if MARK not in pair):
            one, other = sorted((script.setdefault(a, {a}), script.setdefault(b, {b})), key=len)
            if one is not other:
                other |= one
                script.update(dict.fromkeys(one, other))
        return sorted({id(s): s for s in script.values()}.values(), key=lambda s: (-len(s), min(s)))

    @classmethod
    def parse(cls, model: bytes) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        return cls([(p.piece, p.score, p.type) for p in proto.pieces], proto.trainer_spec.model_type, norm.add_dummy_prefix)

    # ---- what merging gives

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """``text`` (one or two pieces long) after all merges - best score first, then leftmost - and the last merge."""
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _half(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that ``piece`` is merged from last; itself twice if it is one character, None if merging never gives it."""
        if piece not in self._halves:
            parts, last = self.merged(piece)
            self._halves[piece] = None if parts != [piece] else last or (piece, piece)
        return self._halves[piece]

    def _holds(self, before: int, piece: int) -> bool:
        """Whether merging the texts of two pieces, one after the other, gives the two back."""
        right = self.names[piece]
        if before >= self.begin:
            return self._half(right) is not None
        left = self.names[before]
        if self._half(left) is None or self._half(right) is None:
            return False
        if left.strip(MARK) == "" or right.strip(MARK) == "":
            return self.merged(left + right)[0] == [left, right]      # runs of marks may tie in score
        # Undo merges along the border, latest first: had an earlier one joined both sides, the pair would not be.
        turn, limit = self.turn, len(self.turn)
        while True:
            across = turn.get(left + right)
            if across is not None and across < limit:
                return False
            for later in ((0, 1) if turn[left] > turn[right] else (1, 0)):
                if later == 0 and len(left) > 1:
                    limit, left = turn[left], self._halves_of(left)[1]
                    break
                if later == 1 and len(right) > 1:
                    limit, right = turn[right] + 1, self._halves_of(right)[0]
                    break
            else:
                return True

    def _ask(self, before: int, piece: int) -> bool:
        """:meth:`_holds`, and remember it. An unknown character never merges, so it stands whatever is before it."""
        if self._asked >= REMEMBERED_PAIRS:
            for known in self._after:
                known.clear()
            self._asked = 0
        self._asked += 1
        holds = self._after[piece][before] = piece == self.stray or self._holds(before, piece)
        return holds

    def _halves_of(self, piece: str) -> tuple[str, str]:
        return self._half(piece) or (piece, piece)

    # ---- the search

    def _best(self, text: str, end: int, edge: dict[int, int], total: dict[int, float]) -> None:
        """Keep the best edge that ends at ``end``."""
        node, at, found = self.backward, end, []
        while at:
            at -= 1
            node = node.get(text[at])
            if node is None:
                break
            piece = node.get(0)
            if piece is not None:
                found.append(piece)
        lengths = self.lengths
        if not found or lengths[found[0]] > 1:
            found.insert(0, self.stray)             # an unknown character
        if self.bpe:
            for piece in reversed(found):
                before = edge.get(end - lengths[piece])
                if before is not None:
                    holds = self._after[piece].get(before)
                    if holds is None:
                        holds = self._ask(before, piece)
                    if holds:
                        edge[end] = piece
                        return
            return
        best = None
        for piece in found:
            before = total.get(end - lengths[piece])
            if before is not None:
                gain = before + (self.unknown_score if piece == self.stray else self.scores[self.names[piece]])
                if best is None or gain > best:
                    best, edge[end] = gain, piece
        total[end] = best

    def stream(self, text: str) -> Iterator[list[str]]:
        """Runs of final pieces, in order. Boundaries further back than the longest piece are forgotten once committed."""
        done = 0                                    # everything before this boundary is committed
        edge: dict[int, int] = {0: self.begin}      # boundary -> the edge that ends there
        total: dict[int, float] = {0: 0.0}
        longest, size = self.longest, len(text)
        for end in range(1, size + 1):
            self._best(text, end, edge, total)
            if end - done >= 2 * longest and end % longest == 0:
                common = self._common(edge, end - longest + 1, end)
                if common > done:
                    yield self._path(text, edge, done, common)
                    done = common
                    for old in [b for b in edge if b < done]:
                        del edge[old]
                        total.pop(old, None)
        if size > done:
            yield self._path(text, edge, done, size)

    def _common(self, edge: dict[int, int], first: int, end: int) -> int:
        """The last boundary that the paths back from all boundaries ``first`` to ``end`` run through."""
        fronts = {b for b in range(first, end + 1) if b in edge}
        while len(fronts) > 1:
            last = max(fronts)
            fronts.remove(last)
            fronts.add(last - self.lengths[edge[last]])
        return fronts.pop()

    def _path(self, text: str, edge: dict[int, int], start: int, end: int) -> list[str]:
        path = []
        while end > start:
            begin = end - self.lengths[edge[end]]
            path.append(text[begin:end])
            end = begin
        return path[::-1]

    # ---- ids

    def _ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return out

    def _search(self, cut: str) -> tuple[int, ...]:
        """Ids of a cut. If it is long, it falls apart further where no piece holds both characters, as all paths run through there."""
        ids = self._short(cut) if self.bpe and len(cut) <= REMEMBERED_CHARS else None
        if ids:
            return ids
        joined = self.joined
        places = [i for i in range(1, len(cut)) if cut[i - 1:i + 1] not in joined]
        if places:
            ends = [0, *places, len(cut)]
            return tuple(chain.from_iterable(self._cuts[cut[a:b]] for a, b in zip(ends, ends[1:])))
        return tuple(i for run in self.stream(cut) for i in self._ids_of(run))

    def _short(self, cut: str) -> tuple[int, ...] | None:
        """:meth:`stream` for a cut that needs no commits, with all edges from one automaton; None if a character is unknown."""
        edge: list[int | None] = [None] * len(cut)            # the edge up to each character; that before the first is -1, the last place
        edge.append(self.begin)
        for last, (piece, length, after) in self.automaton.iter(cut):     # of those that end at one place the longest comes first
            if edge[last] is None:
                before = edge[last - length]
                if before is not None:
                    holds = after.get(before)
                    if holds is None:
                        holds = self._ask(before, piece)
                    if holds:
                        edge[last] = piece
        lengths, ids, last = self.lengths, [], len(cut) - 1
        while last >= 0:
            piece = edge[last]
            if piece is None:
                return None
            ids.append(piece)
            last -= lengths[piece]
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str, out: array) -> None:
        """Append the ids of ``text`` to ``out``."""
        if text:
            marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
            cuts = self.cut.findall(marked) if self.cut else (marked,)
            out.extend(chain.from_iterable(map(self._cuts.__getitem__, cuts)))

    def decode(self, ids: list[int]) -> str:
        text_of, bytes_of = self.text_of, self.bytes_of
        if bytes_of.keys().isdisjoint(ids):
            text = "".join(map(text_of.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in ids:
                byte = bytes_of.get(i)
                if byte is not None:
                    run += byte
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                parts.append(text_of[i])
            parts.append(run.decode("utf-8", "replace"))
            text = "".join(parts)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces.parse(model)


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def _put(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), column],
                                      names=[*(batch.schema.names[i] for i in kept), name])


def encode(docs: DataFrame, model_file: str, text_column: str = "text", ids_column: str = "ids",
           decoded_column: str | None = None) -> DataFrame:
    """``docs`` with the ids of the whole texts and, if asked for, what they decode to (in the same pass).

    The model file is read by the driver; its bytes go with the tasks.
    """
    with open(model_file, "rb") as file:
        model = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column))
            ids, ends, decoded = array("i"), [0], []
            for text in texts:
                text = text.as_py()
                pieces.encode(text or "", ids)
                ends.append(len(ids))
                if decoded_column:
                    decoded.append(None if text is None else pieces.decode(ids[ends[-2]:].tolist()))
            flat = pa.array(np.frombuffer(ids, dtype=np.int32) if ids else np.zeros(0, np.int32))
            coded = _put(batch, ids_column, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=texts.is_null()))
            yield _put(coded, decoded_column, pa.array(decoded, pa.string())) if decoded_column else coded

    fields = _with(docs.schema, ids_column, T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(run, _with(fields, decoded_column, T.StringType()) if decoded_column else fields)


def decode(docs: DataFrame, model_file: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for."""
    with open(model_file, "rb") as file:
        model = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_column))
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            texts = [pieces.decode(flat[a:b].tolist()) if ok else None for a, b, ok in zip(ends[:-1], ends[1:], valid)]
            yield _put(batch, text_column, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, _with(docs.schema, text_column, T.StringType()))
