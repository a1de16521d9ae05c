import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.llm.common import ship

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
# Names that the operators use inside; a table may have them too.
CLASHING = ["row", "pairs", "token", "host", "path", "rule", "n", "key", "node", "head", "component", "value", "id", "size", "slice", "bands", "rows", "words", "taken", "kept",
            "mix_id", "mix_source", "mix_size", "kept_id", "kept_print", "repeated_id", "_near_print", "good_id", "own_id", "set_print", "drawn", "d", "p",
            "unit_id", "matches", "ids", "score", "stays", "finish", "run", "quality", "trusted", "centre", "member", "hashes"]


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text[, source]) tuples as a documents table with extra columns of clashing names."""
    ship(spark)

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        return spark.createDataFrame(full, DOCS).select("*", *[F.lit("extra").alias(c) for c in CLASHING])

    return make


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id LONG, quality INT, toxic INT")
