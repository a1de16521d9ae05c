"""Repeated strings: windows of one block are told apart, rows are places of their own."""

import numpy as np
from conftest_llm import prose

from millrace.llm import suffix_dedup
from millrace.llm.common import staged


def test_windows_of_a_block_are_told_apart():
    """Windows under one head that differ are never taken for each other, however many there are."""
    draw, head = np.random.default_rng(1), bytes(range(1, 94))
    ends = draw.integers(0, 256, (200_000, 7), dtype=np.uint8)
    text = b"".join(head + bytes(e) for e in ends)
    at = np.arange(len(ends)) * 100
    whole = suffix_dedup.window_rests(text, at, np.zeros(len(at), np.int64))
    assert len(np.unique(whole)) == len(np.unique(ends, axis=0))
    other = b"abcdefg" + head + b"hijklmn"
    places = suffix_dedup.window_rests(other, np.arange(8), np.arange(7, -1, -1))
    assert len(set(places.tolist())) == 8
    again = suffix_dedup.window_rests(b"__" + other[2:], np.arange(8), np.arange(7, -1, -1))
    assert (places != again).tolist() == [True, True] + [False] * 6


def test_window_numbers_are_wide(docs_of, monkeypatch):
    """What is compared under one head has room for all bytes that the head leaves out."""
    kinds = []
    monkeypatch.setattr(suffix_dedup, "staged", lambda df, name: (kinds.append((name, dict(df.dtypes))), staged(df, name))[1])
    passage = prose(77, 40)
    suffix_dedup.remove_repeats(docs_of([(i, passage + f" {i:07d} {prose(i, 30)}") for i in range(30)])).collect()
    assert [k["window"] for n, k in kinds if n == "suffix-windows"] == ["bigint"]


def test_rows_without_or_with_one_id_are_places_of_their_own(docs_of):
    passage, other = prose(77, 30), prose(78, 60)
    rows = [(1, f"{passage} {prose(1, 40)}"), (None, f"{passage} {prose(2, 40)}"), (None, prose(3, 80)), (None, other), (None, other),
            (7, f"{passage} {prose(4, 40)}"), (7, prose(5, 80)), (None, None), (None, "short")]
    found = suffix_dedup.remove_repeats(docs_of(rows)).select("doc_id", "n_bytes", "n_removed", "kept_bytes").collect()
    left = sorted((r.kept_bytes or b"").decode() for r in found)
    # The passage goes from all but the first row, a row of equal texts stays, and no byte of another text is lost.
    whole = [f"{passage} {prose(1, 40)}", prose(3, 80), other, "", prose(5, 80), "", "short"]
    assert all(text in left for text in whole) and left.count(other) == 1 and left.count("") == 2
    rest = [text for text in left if text not in whole]
    assert len(rest) == 2 and all(prose(n, 40) in " ".join(rest) for n in (2, 4)) and not any(passage in text for text in rest)
    assert {r.doc_id for r in found if r.n_removed} == {None, 7}
