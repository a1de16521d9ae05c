"""Exact copies, near copies, repeated strings: against brute force, and on every odd kind of row."""

import hashlib
import random
import re
from collections import Counter

import pytest
from conftest_llm import EDGES, prose
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, near_dedup, suffix_dedup
from millrace.llm.common import staged
from millrace.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- exact ---------------------------------------------------------------------------------------

def exact_brute(rows):
    def norm(text):
        return "".join(WORD.findall(text or ""))

    groups = {}
    for number, text, *_ in rows:
        groups.setdefault(norm(text), []).append((-len(text or ""), number is None, number or 0, number))
    out = []
    for number, text, *_ in rows:
        group = groups[norm(text)]
        out.append((number, min(group)[3], len(group), hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def exact_rows(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()], key=repr)


def test_exact_equals_brute_force(docs_of):
    table = EDGES + [(20, "tw owords"), (21, "two  wor ds"), (22, "two\twor d\ns")]
    found = exact_dedup.verdicts(docs_of(table))
    assert exact_rows(found) == exact_brute(table)
    kept = Counter(r.text_sha256 for r in found.where("kept").collect())
    assert set(kept.values()) == {1} and len(kept) == len({r[3] for r in exact_brute(table)})


def test_exact_keeps_whole_rows(docs_of):
    table = docs_of(EDGES)
    out = exact_dedup.drop_copies(table)
    assert out.columns == table.columns
    assert out.count() == len({r[3] for r in exact_brute(EDGES)})
    assert exact_dedup.drop_copies(docs_of([])).count() == 0 and exact_dedup.verdicts(docs_of([])).count() == 0


def test_exact_index_is_compacted(spark, docs_of):
    index, buckets = exact_dedup.new_index(spark)
    for start in range(0, 60, 20):
        exact_dedup.verdicts(docs_of([(k, f"text {k}") for k in range(start, start + 20)]), index, buckets).count()
    before = {tuple(r) for r in spark.table(index).collect()}
    many = len(spark.table(index).inputFiles())
    place = exact_dedup.compact_index(spark, index, buckets)
    files = spark.table(index).inputFiles()
    assert len(files) <= buckets < many and all(place in f for f in files)
    assert {tuple(r) for r in spark.table(index).collect()} == before and len(before) == 60
    assert exact_dedup.verdicts(docs_of([(99, "te xt 7"), (98, "new")]), index, buckets).where("kept").count() == 1
    joined = spark.createDataFrame([("x",)], "text_sha256 STRING").hint("merge").join(spark.table(index), "text_sha256", "left_anti")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    spark.sql(f"DROP TABLE {index}")
    exact_dedup.open_index(spark, index, place, buckets)
    assert spark.table(index).count() == 61


def test_exact_index_is_compacted_when_empty(spark, docs_of):
    index, buckets = exact_dedup.new_index(spark)
    exact_dedup.compact_index(spark, index, buckets)
    assert exact_dedup.verdicts(docs_of([(1, "a"), (2, "a")]), index, buckets).where("kept").count() == 1


def test_exact_index_persists(spark, docs_of):
    index, buckets = exact_dedup.new_index(spark)
    first = exact_dedup.verdicts(docs_of([(5, "a b"), (6, "c")]), index, buckets)
    assert first.where("kept").count() == 2
    again = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.verdicts(docs_of([(1, "ab"), (2, "d"), (3, "d")]), index, buckets).collect()}
    assert again == {1: (5, False), 2: (2, True), 3: (2, False)}
    assert spark.table(index).count() == 3
    location = spark.sql(f"DESCRIBE TABLE EXTENDED {index}").where("col_name = 'Location'").first()["data_type"]
    spark.sql(f"DROP TABLE {index}")                            # as in another session: the files are all there is
    exact_dedup.open_index(spark, index, location, buckets)
    later = exact_dedup.verdicts(docs_of([(9, "c c"), (8, "c")]), index, buckets).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in later} == {(8, 6, False), (9, 9, True)}
    joined = spark.createDataFrame([("x",)], "text_sha256 STRING").hint("merge").join(spark.table(index), "text_sha256", "left_anti")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1   # not of the index


def test_exact_hot_text(docs_of):
    table = [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(600)]
    assert exact_rows(exact_dedup.verdicts(docs_of(table))) == exact_brute(table)


def test_exact_plan_is_native(spark, docs_of):
    plan = exact_dedup.verdicts(docs_of([(1, "a")]).withColumn("doc_id", F.col("doc_id")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- near ----------------------------------------------------------------------------------------

def shingles_of(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def near_brute(rows):
    sets = {n: shingles_of(t) for n, t, *_ in rows if n is not None}
    group = {n: n for n in sets}

    def top(n):
        while group[n] != n:
            n = group[n]
        return n

    numbers = sorted(sets)
    for i, a in enumerate(numbers):
        for b in numbers[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {n: (len(sets[n]), top(n), top(n) == n) for n in sets}


def near_rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def variants(base, copies, edits, seed):
    """Copies of a text with ``edits`` words changed in each: many stay above the limit, some fall below."""
    draw, words = random.Random(seed), base.split()
    for _ in range(copies):
        own = list(words)
        for at in draw.sample(range(len(own)), draw.randint(0, edits)):
            own[at] = f"x{draw.randint(0, 10 ** 6)}"
        yield " ".join(own)


def test_near_equals_brute_force(docs_of):
    table = [(100 + i, t) for i, t in enumerate(variants(prose(3, 90), 120, 8, 1))]
    table += [(400 + i, t) for i, t in enumerate(variants(prose(4, 40), 40, 3, 2))]
    table += [(600 + i, prose(50 + i, 60)) for i in range(40)] + [(700, "A b C"), (701, "a B c"), (702, "a b"), (703, "Ä b c"), (704, "ä b c")]
    assert near_rows(near_dedup.groups(docs_of(table))) == near_brute(table)


def test_near_outsiders_are_found(docs_of, monkeypatch):
    """With cells of a few rows, members that no centre links are still compared with all others."""
    monkeypatch.setattr(near_dedup, "CELL", 7)
    monkeypatch.setattr(near_dedup, "SALTED", 5)
    monkeypatch.setattr(near_dedup, "SLAB", 16)
    table = [(i, t) for i, t in enumerate(variants(prose(9, 60), 90, 6, 7))]
    assert near_rows(near_dedup.groups(docs_of(table))) == near_brute(table)


def test_near_odd_rows(docs_of):
    found = near_dedup.groups(docs_of(EDGES))
    assert found.count() == len(EDGES)
    rows = {r.doc_id: r for r in found.where("doc_id IS NOT NULL").collect()}
    assert rows[1].n_shingles == rows[2].n_shingles == rows[3].n_shingles == 0
    assert all(rows[n].kept for n in (1, 2, 3)) and rows[5].component_id == 4 and rows[8].component_id == 7
    assert rows[10].component_id == 9 and rows[9].n_shingles == 20_000 - 4
    loose = {(r.n_shingles, r.component_id) for r in found.where("doc_id IS NULL").collect()}
    assert loose == {(1, 6), (0, None)}
    kept = near_dedup.drop_near_copies(docs_of(EDGES))
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 6, 7, 9, 11, 12]
    assert near_dedup.groups(docs_of([])).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 103), (103, 102), (101, 102), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "a LONG, b LONG")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}
    assert components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


def test_sketch_estimates_similarity():
    from millrace.llm import shingles
    import numpy as np
    values = shingles.mixed(np.arange(3000, dtype=np.uint64))
    sets = [np.sort(values[:2000]), np.sort(values[500:2500]), values[:1]]
    sketch = near_dedup.sketches(np.concatenate(sets), np.array([2000, 2000, 1]), 960)
    assert not (sketch == near_dedup._EMPTY).any()
    assert abs((sketch[0] == sketch[1]).mean() - 1500 / 2500) < 0.06


# -- repeated strings ----------------------------------------------------------------------------

def suffix_brute(rows):
    seen, out = set(), {}
    for number, text in sorted((r[0], (r[1] or "").encode()) for r in rows):
        mask = bytearray(len(text))
        for s in range(len(text) - 99):
            window = text[s:s + 100]
            if window in seen:
                mask[s:s + 100] = b"\x01" * 100
            seen.add(window)
        left = bytes(b for b, m in zip(text, mask) if not m)
        out[number] = (len(text), sum(mask), len(re.findall(b"\x01+", bytes(mask))), hashlib.sha256(left).hexdigest())
    return out


def suffix_rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_repeats_equal_brute_force(docs_of):
    draw, passage = random.Random(4), prose(77, 40)
    table = [(i, f"{prose(i, draw.randint(0, 30))} {passage[draw.randint(0, 60):draw.randint(150, 230)]} {prose(i + 900, 12)}") for i in range(60)]
    table += [(100, "=" * 350), (101, "=" * 99), (102, "=" * 100), (103, "ab" * 160), (104, "xab" * 90 + "ü" * 80), (105, None), (106, ""),
              (107, prose(7, 60)), (108, prose(7, 60)), (109, "é" * 60 + prose(7, 60)[:140])]
    found = suffix_dedup.remove_repeats(docs_of(table))
    assert suffix_rows(found) == suffix_brute(table)
    kept = {r.doc_id: r.kept_bytes for r in found.collect()}
    assert hashlib.sha256(kept[108]).hexdigest() == suffix_rows(found)[108][3]


def test_repeats_odd_rows(docs_of):
    found = suffix_dedup.remove_repeats(docs_of(EDGES))
    rows = {r.doc_id: r for r in found.where("doc_id IS NOT NULL").collect()}
    assert found.count() == len(EDGES)
    assert rows[1].n_bytes == 0 and rows[7].n_removed == 0 and rows[8].n_removed == rows[8].n_bytes and rows[8].n_spans == 1
    assert rows[10].n_removed == rows[9].n_bytes and rows[11].n_removed == rows[11].n_bytes - 2
    assert suffix_dedup.remove_repeats(docs_of([])).count() == 0


@pytest.mark.parametrize("spans, expected", [
    ([], (0, 0, b"abcdefgh")), ([(0, 8)], (8, 1, b"")), ([(1, 3), (3, 5)], (4, 1, b"afgh")), ([(5, 99), (0, 2)], (5, 2, b"cde")),
    ([(1, 5), (2, 3)], (4, 1, b"afgh"))])
def test_cut(spans, expected):
    assert suffix_dedup.cut(b"abcdefgh", spans) == expected


def test_staged_rows_are_fixed(spark):
    drawn = staged(spark.range(50).select(F.rand().alias("r")), "t")
    assert drawn.collect() == drawn.collect()
