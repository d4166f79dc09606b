"""Word vectors learnt in blocks: words of one theme lie together, the driver
is sent no words, and odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidings.operators import skipgram
from tidings.operators import text as T
from tidings.plans import queries as Q


def themes(n):
    """Texts of two themes of 20 words each, and words that occur in both."""
    rng = np.random.default_rng(1)
    return [(i, [f"t{i % 2}w{j}" for j in rng.integers(0, 20, 30)] + ["both"]) for i in range(n)]


def unit(vectors):
    x = {r.word: np.array(r.vec) for r in vectors.collect()}
    return {w: v / np.linalg.norm(v) for w, v in x.items()}


@pytest.mark.parametrize("block_tokens,max_iter", [(1 << 20, 1), (30_000, 1), (30_000, 2)])
def test_words_of_a_theme_lie_together(spark, block_tokens, max_iter):
    td = spark.createDataFrame(themes(3000), "doc_id long, tokens array<string>")
    vocabulary, vectors = T.fit_word2vec(td, 16, 5, 1, 42, max_iter, block_tokens)
    x = unit(vectors)
    assert len(x) == 41 and all(v.shape == (16,) for v in x.values())
    near = np.mean([x[f"t{k}w{i}"] @ x[f"t{k}w{j}"] for k in (0, 1) for i in range(20) for j in range(i)])
    far = np.mean([x[f"t0w{i}"] @ x[f"t1w{j}"] for i in range(20) for j in range(20)])
    assert near > far + 0.5
    assert {r.word: r.n for r in vocabulary.collect()}["both"] == 3000


def test_no_words_or_vectors_pass_the_driver(spark, monkeypatch):
    """Spark ML's fit kept the vocabulary and two vectors a word on the driver."""
    from pyspark.ml import feature

    def refuse(*args, **kw):
        raise AssertionError("fitted on the driver")
    monkeypatch.setattr(feature, "Word2Vec", refuse)
    td = spark.createDataFrame(themes(40), "doc_id long, tokens array<string>")
    assert T.fit_word2vec(td, 8)[1].count() == 41
    _, vectors, cvm, lda = Q.build_topics(td, 20, 2, 1, 1.0, 8, 2)
    assert vectors.count() >= 41 and T.topic_terms(cvm, lda, 3).count() == 6


def test_odd_rows_and_min_count(spark):
    rows = [(1, ["a", "b", "a"]), (1, ["a", "b", "a"]), (None, ["a", None, "c"]), (2, []), (3, None), (4, ["d"])]
    td = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    vocabulary, vectors = T.fit_word2vec(td, 4, block_tokens=2)
    assert {r.word: r.n for r in vocabulary.collect()} == {"a": 5, "b": 2, "c": 1, "d": 1}
    got = {r.word: r.vec for r in vectors.collect()}
    assert sorted(got) == ["a", "b", "c", "d"] and all(np.isfinite(v).all() and len(v) == 4 for v in got.values())
    assert sorted(r.word for r in T.fit_word2vec(td, 4, min_count=2)[1].collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        T.fit_word2vec(td, 4, min_count=9)


def test_same_vectors_again(spark):
    td = spark.createDataFrame(themes(60), "doc_id long, tokens array<string>").repartition(3).localCheckpoint()
    one, two = (sorted((r.word, r.vec) for r in T.fit_word2vec(td, 8, block_tokens=500)[1].collect()) for _ in range(2))
    assert one == two


def test_first_vectors_depend_on_the_word_alone():
    x = skipgram.first_vectors(np.array([5, -7, 5]), 50)
    assert (x[0] == x[2]).all() and (x[0] != x[1]).any() and (np.abs(x) <= 0.01).all() and abs(x.mean()) < 0.002


def test_average_weighs_by_occurrences():
    rows = pa.table({"word": ["a", "b", "a"], "here": pa.array([3, 2, 1], pa.int64()),
                     "vec": pa.array([[1.0, 0.0], [5.0, 5.0], [5.0, 4.0]], pa.list_(pa.float32()))})
    assert skipgram.average(rows).to_pylist() == [{"word": "a", "here": 4, "vec": [2.0, 1.0]},
                                                 {"word": "b", "here": 2, "vec": [5.0, 5.0]}]
