"""Licences that read alike, notices that say the opposite, and training on whole texts."""

import pytest
import pyarrow as pa
from conftest_llm import prose

from millrace.llm import license_scan, quality_crf
from millrace.llm.license_texts import NOTICES

INDEX = license_scan.Index.of(NOTICES)


def named(text):
    return [m["license"] for m in license_scan.scan_texts(pa.array([text]), INDEX)[0]]


@pytest.mark.parametrize("text, want", [
    ("Licensed under CC BY-ND 4.0", ["CC-BY-ND-4.0 (named)"]), ("Licensed under CC BY 3.0.", ["CC-BY-3.0 (named)"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0 (named)"]),
    ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0 (named)"]), ("Licensed under CC BY 2.5.", []),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1 (named)"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0 (named)"]),
    ("This work is licensed under the GNU General Public License, version 4.", []),
    ("This is NOT released under the MIT License.", []), ("not good. Also see below, it was released under the MIT License.", ["MIT (named)"]),
    ("Licensed under the Apache License, Version 1.1.", []), ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0 (named)"])])
def test_neighbours_are_told_apart(text, want):
    assert named(text) == want
    assert named(f"{prose(3, 40)} {text} {prose(4, 40)}") == want


def test_every_template_finds_itself():
    for name, text in NOTICES.items():
        assert name in named(text), name
    header = NOTICES["AGPL-3.0-or-later"]
    assert named(header) == ["AGPL-3.0-or-later"] and named(header.replace("Affero ", "")) == ["GPL-3.0-or-later"]
    assert named(NOTICES["BSD-2-Clause"].replace("1.", "*").replace("2.", "*")) == ["BSD-2-Clause"]


def test_training_reads_whole_texts(docs_of, labels_of):
    """Good and bad documents that differ behind line 64 only are told apart; repeated ids are one document each."""
    good = "\n".join(["a line."] * 80 + [prose(k, 9) + "." for k in range(80)])
    bad = "\n".join(["a line."] * 80 + ["### $$ 123 @@ ##"] * 80)
    # Both kinds of ids occur in the training folds.
    docs = [(n, good if n % 2 else bad) for n in range(60)] + [(3, bad)] * 30 + [(None, bad)]
    labels = labels_of([(n, n % 2, 0) for n in range(60)])
    field = quality_crf.train(docs_of(docs), labels)
    scores = {r.doc_id: r.score for r in quality_crf.score(docs_of(docs[:60]), field).collect()}
    assert all((s >= 0.5) == (n % 2 == 1) for n, s in scores.items())
    short = quality_crf.train(docs_of(docs), labels, lines=2 * 160 * 3)           # three documents of each kind
    assert quality_crf.score(docs_of(docs[:60]), short).count() == 60
    nothing = quality_crf.train(docs_of(docs), labels, lines=0)
    assert quality_crf.score(docs_of(docs[:3]), nothing).count() == 3
