import zlib

import numpy as np

from tidings.llm import quality as Q
from tidings.llm.common import documents
from tidings.session import read_table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.quality for r in read_table(spark, SF, "labels").collect()}
    rows = Q.query(spark, SF).collect()
    assert len(rows) == documents(spark, SF).count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in held]) >= 0.95
    assert np.mean([p for p, t in held if t == 1]) >= 0.97


def test_held_out_labels_are_not_read(spark):
    """Other labels of held-out rows leave every score as it was."""
    docs, labels = documents(spark, SF), read_table(spark, SF, "labels")
    changed = labels.selectExpr("doc_id", "if(pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0, "
                                "1 - quality, quality) AS quality")
    a, b = (sorted(map(tuple, Q.quality_scores(docs, x).collect())) for x in (labels, changed))
    assert a == b


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        y = rng.integers(0, 2, 12).astype(float)
        got = Q.isotonic(y, np.ones(12))
        want = [max(min(y[a:b + 1].mean() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(got, want)


def test_features_approximate_the_kernel():
    d = len(Q.STATS)
    m = Q.Model(np.zeros(d), np.ones(d), np.zeros(0), np.zeros(0), np.zeros(0))
    x = np.random.default_rng(1).normal(size=(20, d))
    z = m.features(x)[:, :Q.N_FEATURES]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * d))
    assert np.abs(z @ z.T - want).max() < 0.2


def test_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (5, 0), (7, 1), (None, 1), (99, 1)],
                                   "doc_id long, quality int")
    got = Q.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    one = Q.quality_scores(docs, labels.where("quality = 1")).collect()
    assert {r.score for r in one} == {1.0}
    assert {r.score for r in Q.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    kept = Q.kept_documents(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_empty(spark, no_docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert Q.quality_scores(no_docs, labels).collect() == []
    assert Q.kept_documents(no_docs, labels).collect() == []
