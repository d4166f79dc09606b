import hashlib
from collections import defaultdict

from tidings.llm import exact_dedup as X


def test_groups_of_awkward_rows(docs):
    got = X.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[hashlib.sha256((r.text or "").encode()).hexdigest()].append(r.doc_id)
    assert sorted((str(r.doc_id), r.text_sha256) for r in got) == sorted(
        (str(d), h) for h, ds in groups.items() for d in ds)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((d for d in ids if d is not None), default=None)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_later_batches_meet_the_index(spark):
    index = X.fresh_index(spark)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id long, text string")
    later = spark.createDataFrame([(9, "b"), (10, "c"), (11, "c")], "doc_id long, text string")
    assert sorted(r.doc_id for r in X.kept_documents(first, index=index).collect()) == [1, 3]
    assert sorted(r.doc_id for r in X.kept_documents(later, index=index).collect()) == [11]
    assert index.read().count() == 3
    assert X.kept_documents(later, index=index).collect() == []  # the same delivery again
    assert not any(r.kept for r in X.exact_dedup(first, index=index).collect())


def test_index_side_is_not_shuffled(spark):
    index = X.fresh_index(spark)
    docs = spark.range(100).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    index.ingest(X.digest_rows(docs))
    new = X.digest_rows(docs).repartition(index.buckets, "digest")
    plan = new.join(index.read().select("digest").hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in text


def test_kept_documents_keep_all_columns(docs):
    got = X.kept_documents(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(
        ["2", "4", "None", "5", "6", "8"])


def test_empty(no_docs):
    assert X.exact_dedup(no_docs).collect() == [] and X.kept_documents(no_docs).collect() == []


def test_a_later_application_opens_the_index(spark, tmp_path):
    """The catalog forgets the table; the folder alone brings the index back."""
    path = str(tmp_path / "digests")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    index = X.DigestIndex(spark, "index_of_one", buckets=3, path=path)
    assert sorted(r.doc_id for r in X.kept_documents(one, index=index).collect()) == [2, 3]
    index.drop()
    assert not spark.catalog.tableExists("index_of_one")
    other = spark.newSession()
    again = X.DigestIndex(other, "index_of_another", path=path)
    assert again.buckets == 3 and again.read().count() == 2
    two = other.createDataFrame([(4, "b"), (5, "c")], "doc_id long, text string")
    assert [r.doc_id for r in X.kept_documents(two, index=again).collect()] == [5]
    assert again.read().count() == 3
    again.drop()


def test_no_table_is_left(spark):
    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    assert X.exact_dedup(docs).count() == 2 and X.kept_documents(docs).count() == 1
    assert {t.name for t in spark.catalog.listTables()} == before
