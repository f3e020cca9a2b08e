import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture()
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with columns that clash with the operators' own."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 1, "x", "y", 2.5, "z") for r in rows]
        return spark.createDataFrame(full, DOCS + ", shard int, key string, node string, score double, `a b` string")
    return make
