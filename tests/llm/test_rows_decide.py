"""Rules and near copies decide per row where ids are NULL or repeat."""

from conftest_llm import prose

from millrace.llm import near_dedup, quality_rules


def test_rules_judge_each_row(docs_of, labels_of):
    rows = [(None, prose(1, 80)), (None, "short"), (None, None), (3, prose(2, 80)), (3, "short"), (4, prose(3, 80))]
    table = docs_of(rows)
    kept = quality_rules.keep_good(table, labels_of([(3, 1, 0)]))
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, prose(1, 80)), (3, prose(2, 80)), (4, prose(3, 80))]


def test_near_copies_without_or_with_one_id(docs_of):
    base, other, third = prose(1, 90), prose(2, 90), prose(3, 90)
    rows = [(None, base), (None, base + " more"), (None, prose(9, 90)), (None, None), (None, " "),
            (7, other), (7, third), (8, other + " more"), (9, third + " more"), (None, third + " again"), (5, prose(4, 90)), (5, prose(4, 90) + " x")]
    table = docs_of(rows)
    found = near_dedup.groups(table).collect()
    assert len(found) == len(rows) and {r.doc_id: r.component_id for r in found if r.doc_id} == {7: 7, 8: 7, 9: 7, 5: 5}
    kept = near_dedup.drop_near_copies(table)
    assert kept.columns == table.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(left) == 7 and {(7, other), (7, third), (None, prose(9, 90)), (None, None), (None, " ")} <= set(left)
    assert sum(n is None and (t or "").startswith(base) for n, t in left) == 1 and sum(n == 5 for n, _ in left) == 1
