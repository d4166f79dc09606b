"""Plan-shape checks: filters reach the scan, no cartesian products."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from tidings.plans import registry
from table_paths import SF_SMALL


def test_vectors_are_joined_once_per_distinct_token(spark):
    """Keywords: vectors meet (document, token) counts, not every occurrence."""
    txt = plan_text(E.queries()["rnk7_keywords"](spark, SF_SMALL))
    assert txt.count("collect_list(pos") and "Checkpoint" not in txt and "Scan ExistingRDD" not in txt


def test_phrases_shuffle_tokens_once(spark):
    from tidings.operators import text as T
    td = spark.createDataFrame([(1, ["a", "b"])], "doc_id long, tokens array<string>")
    ph = spark.createDataFrame([("a", "b")], "a string, b string")
    txt = T.apply_phrases(td, ph)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(doc_id" in line for line in txt.splitlines()) <= 2


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_window_and_role_filters_reach_the_scan(spark, tmp_path):
    from tidings.plans import fixtures as X
    from tidings.plans import queries as Q
    path = str(tmp_path / "news")
    X.news_like(spark, SF_SMALL).write.parquet(path)
    news = spark.read.parquet(path)
    txt = plan_text(Q.select_window(news, X.roles_table(spark), X.AT, X.ROLE, 7).select("id"))
    assert "GreaterThanOrEqual(timestamp" in txt and "LessThanOrEqual(timestamp" in txt
    assert "LeftSemi" in txt
    # column pruning: the projection does not read the article text
    scan = [line for line in txt.splitlines() if line.startswith("ReadSchema")][0]
    assert "text" not in scan


# plans that run jobs of their own before they are read are left out
LAZY = sorted(k for k in registry.oracle_sql() if not k.startswith(
    ("src", "cln7", "clu", "q4", "q5", "q9", "agg9", "txt1", "txt2", "jn8", "jn14", "rnk5", "rnk6", "flt7", "flt8", "vec")))


@pytest.mark.parametrize("key", LAZY)
def test_no_cartesian_product(spark, key):
    txt = plan_text(E.queries()[key](spark, SF_SMALL))
    assert "CartesianProduct" not in txt
    assert "BroadcastNestedLoopJoin" not in txt
