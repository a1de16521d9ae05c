"""Tokens, transcripts, licences, mixing and the pipeline."""

import random
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import EDGES, LONG, prose
from pyspark.sql import functions as F

from millrace.llm import chat_format, license_scan, mixing, near_dedup, pieces, queries, quality_rules
from millrace.llm.license_texts import NOTICES, TELLING

MODEL = queries.PIECE_MODEL


# -- pieces --------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as file:
        return pieces.Pieces.parse(file.read())


def ids(model, text):
    out = array("i")
    model.encode(text, out)
    return out.tolist()


def test_ids_are_the_librarys(model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    draw = random.Random(1)
    parts = ["a", "b", " ", "  ", "the", "ing", "\n", "漢", "😀", "é", " the", "aaa", "ababababab", "       ", "\t", "12", "==", ".", "***", "\x00"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 50))) for _ in range(1500)]
    texts += [" " * n + end for n in range(40) for end in ("", "w", "\n")] + [LONG, "ab" * 6000, " " * 3000 + "a" * 5000, "ü漢" * 2000]
    for text in texts:
        own = ids(model, text)
        assert own == library.encode(text), text[:80]
        assert model.decode(own) == text


def test_long_and_short_searches_agree(model):
    for text in ("thesearetheletters" * 2, "unbelievable,really", "xyzzy漢"):
        assert [p for run in model.stream(text) for p in run] == [model.names[i] for i in model._search(text)] or "漢" in text
    assert len(list(model.stream(prose(1, 300).replace(" ", "")))) > 5         # commits on the way


def test_scripts_are_cut_from_each_other(model):
    import sentencepiece

    assert model.cut.findall("▁▁maison.Дом,▁(жar)7") == ["▁▁maison", ".", "Дом", ",", "▁(", "ж", "ar", ")", "7"]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    draw = random.Random(3)
    letters = "abehilnorstÉéßžčЖживсуем.,!?'\"(){}\\$%-«»’…ÁŁØ£©¿一个取获据数ال漢😀\u200b\r\t\n09 ▁  "
    for _ in range(2000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(1, 70)))
        cuts = model.cut.findall(text.replace(" ", pieces.MARK))
        assert "".join(cuts) == text.replace(" ", pieces.MARK)
        assert all(a[-1] + b[0] not in model.joined or a[-1] != pieces.MARK == b[0] for a, b in zip(cuts, cuts[1:]))
        assert ids(model, text) == library.encode(text), text


def test_unigram_search_finds_the_best_sum():
    words = {"a": -2.0, "b": -2.5, "ab": -3.0, "abc": -3.2, "c": -4.0, "bc": -3.5, "ca": -3.1, "▁": -1.0, "▁a": -2.2}
    own = pieces.Pieces([("<unk>", 0.0, pieces.UNKNOWN), *((p, s, pieces.NORMAL) for p, s in words.items())], pieces.UNIGRAM, dummy_prefix=False)

    def best(text):
        top = {0: 0.0}
        for end in range(1, len(text) + 1):
            top[end] = max(top[s] + words.get(text[s:end], own.unknown_score if end - s == 1 else float("-inf")) for s in range(max(0, end - 3), end))
        return top[len(text)]

    draw = random.Random(2)
    for _ in range(200):
        text = "".join(draw.choice("abc▁x") for _ in range(draw.randint(1, 40)))
        found = [p for run in own.stream(text) for p in run]
        assert "".join(found) == text
        assert sum(words.get(p, own.unknown_score) for p in found) == pytest.approx(best(text))
    assert ids(own, "x") == [0]


def test_unsupported_models():
    with pytest.raises(ValueError):
        pieces.Pieces([("a", 0.0, pieces.USER_DEFINED)], pieces.BPE)
    with pytest.raises(ValueError):
        pieces.Pieces([("a", 0.0, pieces.NORMAL)], 3)


def test_coding_tables(docs_of):
    table = docs_of(EDGES)
    coded = pieces.decode(pieces.encode(table, MODEL), MODEL)
    assert [c for c in coded.columns if c not in ("ids", "decoded")] == [c for c in table.columns if c != "ids"]
    assert coded.where(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0
    assert coded.where("ids IS NULL").count() == 2 and coded.where("size(ids) = 0").count() == 1
    both = pieces.encode(table, MODEL, decoded_column="decoded")
    assert both.exceptAll(coded.select(both.columns)).count() == 0
    assert pieces.encode(docs_of([]), MODEL).count() == 0


# -- transcripts ---------------------------------------------------------------------------------

TALK = "conv_id LONG, turn LONG, role STRING, text STRING"


def talks(n, seed):
    draw, rows = random.Random(seed), []
    for c in range(n):
        marks = draw.choice([("User: ", "Assistant: "), ("Q: ", "A: "), ("<|user|>", "<|assistant|>"), ("### Human:\n", "### AI:\n")])
        for t in range(draw.randint(2, 8)):
            who = t % 2
            body = prose(c * 50 + t, 8 if who == 0 else 60) + ("?" if who == 0 else "\n" + prose(c, 30))
            rows.append((c, t, ("user", "assistant")[who], ("" if draw.random() < 0.2 else marks[who]) + body))
    return rows


def test_roles_are_recovered(spark, docs_of):
    train, test = talks(60, 1), talks(40, 2)
    model = chat_format.train(spark.createDataFrame(train, TALK), "conv_id", "turn", "text", "role")
    found = chat_format.parse(spark.createDataFrame(test, TALK), model, "conv_id", "turn", "text").collect()
    truth = {(c, t): r for c, t, r, _ in test}
    assert sum(r.line_roles[0] == truth[r.transcript, r.place] for r in found) / len(found) > 0.95


def test_segments_decode_as_one(spark, docs_of, monkeypatch):
    table = spark.createDataFrame([(1, t, *r[2:]) for t, r in enumerate(talks(30, 3))], TALK)
    model = chat_format.train(table, "conv_id", "turn", "text", "role")
    whole = {r.place: r.rendered for r in chat_format.parse(table, model, "conv_id", "turn", "text").collect()}
    monkeypatch.setattr(chat_format, "SEGMENT", 5)
    parts = {r.place: r.rendered for r in chat_format.parse(table, model, "conv_id", "turn", "text").collect()}
    assert parts == whole
    text = "".join(whole[k] for k in sorted(whole))
    assert text.count("<|im_start|>") == text.count("<|im_end|>") > 30 and text.endswith("<|im_end|>\n")


def test_viterbi_equals_enumeration():
    draw = np.random.default_rng(5)
    states = chat_format._STATES
    model = chat_format.Model(draw.normal(size=states), draw.normal(size=(states, states)))
    gains = draw.normal(size=(4, states))
    paths = {}
    for code in range(states ** 4):
        path = [code // states ** k % states for k in range(4)]
        paths[tuple(path)] = (model.start[path[0]] + sum(gains[k, s] for k, s in enumerate(path)) + sum(model.move[a, b] for a, b in zip(path, path[1:])))
    best = max(paths, key=paths.get)
    assert tuple(model.decode(gains, None, None)) == best
    assert model.reduce(gains, True)[0].max() == pytest.approx(paths[best])


def test_transcript_odd_rows(spark, docs_of):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (None, None, None, "x"), (2, None, "bot", "User: a\nAssistant: b")]
    table = spark.createDataFrame(rows, TALK).withColumn("segment", F.lit("extra")).withColumn("best", F.lit(1))
    model = chat_format.train(table.limit(0), "conv_id", "turn", "text", "role")
    found = chat_format.parse(table, model, "conv_id", "turn", "text")
    assert found.count() == 5
    assert chat_format.parse(table.limit(0), model, "conv_id", "turn", "text").count() == 0


# -- licences ------------------------------------------------------------------------------------

def local_alignment(template, text):
    """Unbanded brute force: most template words in order with gaps and changes at cost 1, gain 2."""
    best, above = (0, 0), [(0, 0)] * (len(text) + 1)
    for word in template:
        row = [(0, 0)]
        for j, other in enumerate(text):
            cell = max((0, 0), (above[j][0] + 2, above[j][1] + 1) if word == other else (above[j][0] - 1, above[j][1]),
                       (row[j][0] - 1, row[j][1]), (above[j + 1][0] - 1, above[j + 1][1]))
            row.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, row[-1])
        above = row
    return best


def test_matches_equal_unbanded_alignment():
    index = license_scan.Index.of(NOTICES)
    draw = random.Random(6)
    for number, (name, notice) in enumerate(sorted(NOTICES.items())):
        words = notice.split()
        for _ in range(len(words) // 12):
            at = draw.randrange(2, len(words) - 2)
            # Words that tell licences apart, and numbers, must stay: without them it is another licence or none.
            if not any(w in TELLING or any(c.isdigit() for c in w) for w in license_scan._WORDS.findall(words[at].lower())):
                words[at:at + 1] = draw.choice([[], ["changed"], [words[at], "added"]])
        text = f"{prose(number, 30)} {' '.join(words)} {prose(number + 90, 30)}"
        found = license_scan.scan_texts(pa.array([text]), index)[0]
        plain = license_scan._WORDS.findall(text.lower())
        scores = {n: local_alignment(license_scan._WORDS.findall(NOTICES[n].lower()), plain) for n in NOTICES}
        match = next(m for m in found if m["license"] == name)
        assert match["matched"] == scores[name][1]
        inside = text[match["start"]:match["end"]].split()
        assert inside[0] in words and inside[-1].rstrip(".,;:") in " ".join(words)


def test_licence_odd_rows(docs_of):
    table = EDGES + [(50, "Ünïcode ahead. " + "Released under the MIT License. " * 3), (51, "released UNDER the mit\nlicense"), (52, "MIT License")]
    found = {r.doc_id: r.matches for r in license_scan.scan(docs_of(table)).collect() if r.doc_id}
    assert len(found[50]) == 3 and len(found[51]) == 1 and not found[52] and not found[1]
    assert found[50][0].start == 15 and found[51][0].coverage == 1.0
    assert license_scan.scan(docs_of([])).count() == 0


# -- mixing --------------------------------------------------------------------------------------

def water(sizes):
    """Targets by resharing until none is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_sources, left = {}, set(names), float(sum(sizes.values()))
    while open_sources:
        share = {s: left * weight[s] / sum(weight[o] for o in open_sources) for s in open_sources}
        above = {s for s in open_sources if share[s] > 3 * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_sources -= above
    return target


def test_mix_targets_and_limits(docs_of):
    draw = random.Random(3)
    table = [(i, prose(i, draw.randint(0, 60)), draw.choice(["b", "a", "c", "é", None, "small"] if i % 40 else ["tiny"])) for i in range(500)]
    table += [(1000 + i, prose(i, 30), "hot") for i in range(300)]
    found = mixing.taken(docs_of(table)).collect()
    sizes, got = defaultdict(int), defaultdict(int)
    for _, text, source in table:
        sizes[source] += len(text.split())
    want = water(sizes)
    for r in found:
        got[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
    assert all(abs(got[s] - want[s]) <= 60 for s in want) and sum(got.values()) <= sum(sizes.values())
    again = mixing.taken(docs_of(table[::-1])).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))
    mixed = mixing.mixed(docs_of(table))
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in found if r.copies})


def test_mix_odd_rows(docs_of):
    found = mixing.taken(docs_of([(n, t, None if i % 2 else "") for i, (n, t) in enumerate(EDGES)]))
    assert found.count() == len(EDGES)
    assert mixing.taken(docs_of([])).count() == 0 and mixing.mixed(docs_of([])).count() == 0
    assert {r.taken for r in mixing.taken(docs_of([(1, None), (2, " ")])).collect()} == {0}
    table = docs_of(EDGES)
    assert mixing.mixed(table).columns == table.columns


# -- pipeline ------------------------------------------------------------------------------------

def test_pipeline_stages(spark, docs_of, folder, labels_of):
    import corpus_pipeline

    rows = [(i, prose(i, 80), f"s{i % 3}") for i in range(40)] + [(50 + i, prose(i, 80) + "  ", "s1") for i in range(5)]
    rows += [(60 + i, prose(i, 80) + " and more words", "s2") for i in range(5)] + [(70 + i, "a | b$$$ | " * 40, "s0") for i in range(4)]
    rows += [(80, None, None), (81, "", "s0")]
    home = folder("tables")
    base = docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars")
    base.write.parquet(f"{home}/documents.parquet")
    labels_of([(i, 1, 0) for i in range(30)] + [(70, 0, 0)]).write.parquet(f"{home}/labels.parquet")
    docs, kept = spark.read.parquet(f"{home}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, home)
        path = folder(name)
        out.write.parquet(path)
        if name != "sentencepiece":
            assert out.columns == base.columns
        docs = spark.read.parquet(path)
        kept[name] = Counter(r.doc_id for r in docs.select("doc_id").collect())
    good = {r.doc_id for r in quality_rules.rules(base, spark.read.parquet(f"{home}/labels.parquet")).where("kept").collect()}
    assert set(kept["quality_rules"]) == good and good >= set(range(40)) and not good & {80, 81}
    assert set(kept["exact_dedup"]) == (good - set(range(50, 55)) - set(range(5))) | set(range(50, 55))     # the longer text stays
    assert set(kept["near_dedup"]) == set(kept["exact_dedup"]) - set(range(60, 65)) or set(kept["near_dedup"]) < set(kept["exact_dedup"])
    groups = near_dedup.groups(base.where(F.col("doc_id").isin(sorted(kept["exact_dedup"]))))
    assert set(kept["near_dedup"]) == {r.doc_id for r in groups.where("kept").collect()}
    assert set(kept["mix_sources"]) <= set(kept["near_dedup"]) and max(kept["mix_sources"].values()) <= 3
    assert kept["sentencepiece"] == kept["mix_sources"]
    assert corpus_pipeline.run(spark, home).count() == sum(kept["sentencepiece"].values())
