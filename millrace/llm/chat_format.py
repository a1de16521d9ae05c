"""Chat transcripts: a hidden Markov model recovers who speaks, then turns are rendered in one canonical form.

A transcript is a table of pieces of text in order. Its lines are the model's steps; a state is a role and whether
the line begins a turn of it. A line shows a speaker marker (of a role's names, of another name, or none), a length
class, whether it ends in a question mark, and whether it is blank. Start, transition and emission chances are counted
on transcripts whose roles are known; Viterbi's path gives the roles where markers are missing or mean nothing.

Long transcripts are not one task's work: Viterbi is a product of matrices (maximum, plus), so each segment of
``SEGMENT`` places is reduced to one small matrix, one row per segment runs over them to find the states at its two
ends, and segments are then decoded apart. All three steps stream over sorted rows and hold one segment, or one
matrix row per segment of one transcript.

Defined cases: NULL text is an empty line; pieces of one place follow each other in the order of their texts; a NULL place
comes last, a NULL transcript id is an id; a piece without lines cannot be, an empty text is one blank line; repeated pieces are
repeated turns; without training rows all chances are even and the first role in order is taken; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import same, staged

ROLES = ("system", "user", "assistant")
SEGMENT = 256
SMOOTHING = 0.5

# Names that transcripts give to the roles.
NAMES = {"system": 0, "instructions": 0, "context": 0,
         "user": 1, "human": 1, "q": 1, "question": 1, "customer": 1, "you": 1, "prompter": 1,
         "assistant": 2, "ai": 2, "bot": 2, "a": 2, "answer": 2, "agent": 2, "model": 2, "gpt": 2, "chatbot": 2}
_OTHER, _NONE = len(ROLES), len(ROLES) + 1
_MARKER = re.compile(r"^\s*(?:[#>*-]+\s*)?(?:<\|?\s*([A-Za-z]{1,12})\s*\|?>|\[([A-Za-z]{1,12})\]|\*{0,2}([A-Za-z]{1,12})\*{0,2}\s*:)\s*")

_STATES = 2 * len(ROLES)                 # role * 2 + 1 begins a turn, role * 2 goes on with it
_SIZES = (len(ROLES) + 2, 6, 2, 2)       # values of the four observations


def observe(line: str) -> tuple[int, int, int, int]:
    match = _MARKER.match(line)
    name = next((g for g in match.groups() if g), "").lower() if match else ""
    marker = NAMES.get(name, _OTHER) if match else _NONE
    body = line.strip()
    return marker, min(len(body).bit_length() // 2, 5), int(body.endswith("?")), int(not body)


@dataclass(frozen=True)
class Model:
    start: np.ndarray = field(default_factory=lambda: np.zeros(_STATES))
    move: np.ndarray = field(default_factory=lambda: np.zeros((_STATES, _STATES)))
    emit: tuple[np.ndarray, ...] = field(default_factory=lambda: tuple(np.zeros((_STATES, n)) for n in _SIZES))

    def gains(self, lines: list[str]) -> np.ndarray:
        """Log chance of each line in each state."""
        seen = np.array([observe(line) for line in lines])
        return sum(self.emit[k][:, seen[:, k]] for k in range(len(_SIZES))).T

    def reduce(self, gains: np.ndarray, first: bool) -> np.ndarray:
        """best[a, b]: the best path from state a before the lines to state b at the last of them."""
        best = (self.start if first else self.move) + gains[0]
        best = np.broadcast_to(best, (_STATES, _STATES))
        for gain in gains[1:]:
            best = (best[:, :, None] + self.move[None]).max(axis=1) + gain
        return best

    def decode(self, gains: np.ndarray, entry: int | None, last: int | None) -> list[int]:
        """The best states, after ``entry`` (None: a transcript begins) and ending in ``last`` (None: in any)."""
        ahead = (self.start if entry is None else self.move[entry]) + gains[0]
        came = np.zeros((len(gains), _STATES), int)
        for k in range(1, len(gains)):
            paths = ahead[:, None] + self.move
            came[k] = paths.argmax(axis=0)
            ahead = paths.max(axis=0) + gains[k]
        state = int(ahead.argmax()) if last is None else last
        states = [state]
        for k in range(len(gains) - 1, 0, -1):
            state = int(came[k][state])
            states.append(state)
        return states[::-1]


def _segments(df: DataFrame) -> DataFrame:
    """Pieces by segment, in order within it: transcript, segment, place, text and what else there is."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "transcript", "segment").sortWithinPartitions(
        F.col("transcript").asc_nulls_first(), "segment", F.col("place").asc_nulls_last(), "text")


def _pieces(df: DataFrame, transcript: str, place: str, text: str, *more: Column) -> DataFrame:
    return df.select(*more, F.col(f"`{transcript}`").cast("bigint").alias("transcript"), F.col(f"`{place}`").cast("bigint").alias("place"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
                     F.coalesce(F.floor(F.col(f"`{place}`").cast("bigint") / SEGMENT), F.lit(2 ** 62)).cast("bigint").alias("segment"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in the first ``keys`` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def train(df: DataFrame, transcript: str, place: str, text: str, role: str) -> Model:
    """Count a model on pieces that each are one turn of a known ``role``; rows of other roles are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(_STATES, np.int64), np.zeros((_STATES, _STATES), np.int64), *(np.zeros((_STATES, n), np.int64) for n in _SIZES)]
        for (_, segment), rows in _groups(batches, 2):
            before = None
            for body, who in rows:
                for k, line in enumerate(body.split("\n")):
                    state = 2 * who + (k == 0)
                    if before is not None:
                        tables[1][before, state] += 1
                    elif segment == 0:
                        tables[0][state] += 1
                    for table, value in zip(tables[2:], observe(line)):
                        table[state, value] += 1
                    before = state
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(t.size, i) for i, t in enumerate(tables)])),
             pa.array(np.concatenate([np.arange(t.size) for t in tables])), pa.array(np.concatenate([t.ravel() for t in tables]))],
            names=["kind", "cell", "n"])

    who = F.array_position(F.array(*map(F.lit, ROLES)), F.lower(F.col(f"`{role}`"))) - 1
    rows = _pieces(df, transcript, place, text, who.cast("bigint").alias("who")).where("who >= 0")
    counted = (_segments(rows).select("transcript", "segment", "text", "who").mapInArrow(count, "kind bigint, cell bigint, n bigint")
               .groupBy("kind", "cell").agg(F.sum("n").alias("n")).where("n > 0"))
    model = Model()
    tables = [np.zeros_like(t) for t in (model.start, model.move, *model.emit)]
    for found in counted.collect():                       # a number per cell of the model's tables, of fixed size
        tables[found.kind].ravel()[found.cell] = found.n
    logs = [np.log(t + SMOOTHING) - np.log((t + SMOOTHING).sum(axis=-1, keepdims=True)) for t in tables]
    return Model(logs[0], logs[1], tuple(logs[2:]))


def _matrices(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches, 2):
            lines = [line for (text,) in rows for line in text.split("\n")]
            best = model.reduce(model.gains(lines), False)
            opening = model.reduce(model.gains(lines), True)[0]
            yield pa.RecordBatch.from_pydict({"transcript": pa.array([key[0]], pa.int64()), "segment": pa.array([key[1]], pa.int64()),
                                              "opening": pa.array([opening.tolist()], pa.list_(pa.float64())),
                                              "best": pa.array([best.ravel().tolist()], pa.list_(pa.float64()))})

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment the states before its first line and at its last line on the transcript's best path."""
    for (transcript,), rows in _groups(batches, 1):
        ahead = [np.array(rows[0][1])]
        best = [np.array(row[2]).reshape(_STATES, _STATES) for row in rows]
        for k in range(1, len(rows)):
            ahead.append((ahead[-1][:, None] + best[k]).max(axis=0))
        state, ends = int(ahead[-1].argmax()), []
        for k in range(len(rows) - 1, -1, -1):
            entry = int((ahead[k - 1] + best[k][:, state]).argmax()) if k else None
            ends.append((transcript, rows[k][0], entry, state, k == len(rows) - 1))
            state = entry
        columns = list(zip(*ends))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                                          pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.bool_())],
                                         names=["transcript", "segment", "entry", "last_state", "is_end"])


def render(lines: list[str], states: list[int], opens: bool, closes: bool) -> str:
    """Lines as canonical turns; ``opens``: a transcript begins here, ``closes``: it ends here. A turn is closed where the next begins."""
    out, bare = [], False                    # bare: the line before was a marker and nothing else
    for k, (line, state) in enumerate(zip(lines, states)):
        if state % 2 or (opens and k == 0):
            marked = observe(line)[0] < _OTHER
            body = _MARKER.sub("", line, count=1) if marked else line
            out.append(("" if opens and k == 0 else "<|im_end|>\n") + f"<|im_start|>{ROLES[state // 2]}\n{body}")
            bare = marked and not body.strip()
        else:
            out.append(line if bare else "\n" + line)
            bare = False
    return "".join(out) + ("<|im_end|>\n" if closes else "")


def _rendered(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches, 2):
            pieces = [text.split("\n") for _, text, _, _, _ in rows]
            entry, last, is_end = rows[0][2:]
            states = model.decode(model.gains([line for piece in pieces for line in piece]), entry, last)
            roles, shown, at = [], [], 0
            for k, piece in enumerate(pieces):
                own = states[at:at + len(piece)]
                at += len(piece)
                roles.append([ROLES[s // 2] for s in own])
                shown.append(render(piece, own, entry is None and k == 0, is_end and k == len(pieces) - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array(roles, pa.list_(pa.string())), pa.array(shown, pa.string())],
                names=["transcript", "place", "text", "line_roles", "rendered"])

    return run


def parse(df: DataFrame, model: Model, transcript: str, place: str, text: str) -> DataFrame:
    """One row per piece: transcript, place, text, line_roles (role of each line) and rendered, its part of the
    canonical form; the parts of a transcript in order are the whole."""
    pieces = staged(_pieces(df, transcript, place, text), "chat-pieces")
    matrices = staged(_segments(pieces).select("transcript", "segment", "text").mapInArrow(
        _matrices(model), "transcript bigint, segment bigint, opening array<double>, best array<double>"), "chat-matrices")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = (matrices.repartition(n, "transcript").sortWithinPartitions(F.col("transcript").asc_nulls_first(), "segment")
            .select("transcript", "segment", "opening", "best")
            .mapInArrow(_ends, "transcript bigint, segment bigint, entry bigint, last_state bigint, is_end boolean"))
    ends = staged(ends, "chat-ends").withColumnsRenamed({"transcript": "t2", "segment": "s2"})
    known = pieces.join(ends, same(pieces.transcript, ends.t2) & (pieces.segment == ends.s2)).drop("t2", "s2")
    return (_segments(known).select("transcript", "segment", "place", "text", "entry", "last_state", "is_end")
            .mapInArrow(_rendered(model), "transcript bigint, place bigint, text string, line_roles array<string>, rendered string"))
