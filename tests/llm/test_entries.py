"""Registered SQL against the queries, on the smallest tables."""

import pytest

from tidings.llm import entries
from tools.oracle_check import duck, frame_digest

SF = "/root/testdata/sf0.001"
SQL = entries.oracle_sql()


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in entries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, key):
    got = frame_digest(entries.queries()[key](spark, SF).toPandas())
    want = frame_digest(duck(SF).execute(SQL[key]).df())
    assert got[:3] == want[:3]
