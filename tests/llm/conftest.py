import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """A small table with the awkward cases: nulls, empty, copies, a long text,
    repeated rows and a column whose name an operator might use."""
    rows = [(1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
            (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
            (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
            (3, "", "en", "b"), (4, None, None, None), (None, "solo text without an id", "en", None),
            (None, None, None, "b"), (5, "Word " * 400_000, "de", "b"), (6, " \t\n ", "fr", "é"),
            (7, "one", "es", "a"), (8, "one", "es", "z")]
    rows = [(*r, None if r[1] is None else len(r[1]), 1) for r in rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, key int")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
