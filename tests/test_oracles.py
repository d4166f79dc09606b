"""Every registered plan with an SQL oracle equals DuckDB on the same tables."""

import pytest

import __spark_entry__ as E
from table_paths import SF_SMALL
from tidings.plans import registry
from tools.oracle_check import duck, frame_digest

SQL = registry.oracle_sql()  # the pipeline's own are in tests/llm


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_oracle_has_a_plan():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_oracle(spark, con, key):
    got = E.queries()[key](spark, SF_SMALL).toPandas()
    want = con.execute(SQL[key]).df()
    a, b = frame_digest(got), frame_digest(want)
    assert a[0] == b[0], f"columns {a[0]} vs {b[0]}"
    assert a[1] == b[1], f"rows {a[1]} vs {b[1]}"
    assert a[2] == b[2], f"values differ: {sorted(set(a[3]) ^ set(b[3]))[:3]}"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) <= 3
    assert {"id", "title", "group", "size"} <= set(df.columns)
