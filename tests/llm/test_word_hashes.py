"""Words that polynomials modulo a power of two cannot tell apart, and the filter of the near-duplicate search."""

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import near_dedup, shingles


def _thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_that_differ_have_other_hashes(docs_of, rows):
    one = _thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    a, b = (shingles.word_hashes([w.encode()])[0] for w in (one, other))
    assert a != b
    found = near_dedup.groups(docs_of([(1, one), (2, other), (3, one)]))
    assert rows(found, "doc_id", "component_id") == [(1, 1), (2, 2), (3, 1)]


def test_a_word_hashes_the_same_wherever_it_stands():
    texts = [b"word", b"  \n word", b"another word " + b" " * 5_000 + b"word", b"x" * 10_000, b"y" + b"x" * 10_000]
    hashes, counts = shingles.word_hashes(texts)
    assert counts.tolist() == [1, 1, 3, 1, 1]
    assert len({int(h) for h in hashes[[0, 1, 3, 4]]}) == 1 and len({int(h) for h in hashes}) == 4


def test_filter_has_no_false_negatives(spark):
    ids = spark.range(0, 3_000, 3).withColumnRenamed("id", "doc_id")
    bits = near_dedup._bloom(ids)
    keys = spark.range(3_000).select(near_dedup._filter_key("id").alias("k"), "id").toPandas()
    passed = near_dedup._passes(bits, keys.k.to_numpy())
    assert passed[keys.id % 3 == 0].all() and passed.sum() < 1_010
    assert not near_dedup._passes(near_dedup._bloom(ids.where(F.lit(False))), keys.k.to_numpy()).any()
    assert near_dedup._passes(np.full_like(bits, -1), keys.k.to_numpy()).all()
