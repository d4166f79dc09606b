"""Words and pairs counted in slices, and phrases joined in the documents' own
tasks: equal to plain counting and to the join with a large phrase table."""

from collections import Counter

import numpy as np
import pytest

from tidings.operators import text as T


def corpus(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [f"w{j}" for j in rng.zipf(1.5, int(rng.integers(0, 60))) % 20]) for i in range(120)]
    rows += [(200, []), (201, None), (202, ["w1"]), (203, ["w1", None, "w1", "w2"]), (None, ["w1", "w1", "w2"])]
    return rows, spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(4)


@pytest.mark.parametrize("tokens", [1, 25, 1 << 21])
def test_counts_of_slices_equal_plain_counts(spark, monkeypatch, tokens):
    rows, td = corpus(spark)
    monkeypatch.setattr(T, "COUNT_TOKENS", tokens)
    words, pairs = Counter(), Counter()
    for _, t in rows:
        words.update(t or [])
        pairs.update(zip(t or [], (t or [])[1:]))
    arrow = td.select("tokens").toArrow().to_batches(max_chunksize=17)
    got = [r for b in T._count_piece(iter(arrow)) for r in b.to_pylist()]
    sums = Counter()
    for r in got:
        sums[(r["pair"], r["a"], r["b"])] += r["n"]
    assert {k[1]: n for k, n in sums.items() if not k[0]} == dict(words)
    assert {k[1:]: n for k, n in sums.items() if k[0]} == dict(pairs)
    model = {(r.a, r.b): (r.n_ab, r.score) for r in T.fit_phrases(td, 3, 0.01).collect()}
    size = len(words) + len(pairs)
    want = {p: (n, (n - 3.0) / (words[p[0]] * words[p[1]]) * size) for p, n in pairs.items()
            if None not in p and n > 3 and words[p[0]] > 3 and words[p[1]] > 3}
    want = {p: x for p, x in want.items() if x[1] > 0.01}
    assert want and model.keys() == want.keys()
    assert all(model[p][0] == want[p][0] and np.isclose(model[p][1], want[p][1]) for p in want)


@pytest.mark.parametrize("mode", ["replace", "append"])
def test_phrases_taken_along_equal_the_join(spark, monkeypatch, mode):
    _, td = corpus(spark)
    ph = spark.createDataFrame([("w1", "w1"), ("w1", "w2"), ("w2", "w3"), ("w3", "w1"), ("w1", "w1"), (None, "w1")],
                               "a string, b string")
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    small = T.apply_phrases(td, ph, mode)
    assert "Exchange hashpartitioning(doc_id" not in small._jdf.queryExecution().executedPlan().toString()
    here = key(small)
    assert key(T.apply_phrases(td, ph.limit(0), mode)) == key(td)
    monkeypatch.setattr(T, "SMALL_PHRASES", 1)
    assert key(T.apply_phrases(td, ph, mode)) == here
    with pytest.raises(ValueError):
        T.apply_phrases(td, ph, "other")


def test_phrases_with_repeated_ids_are_joined_row_by_row(spark):
    td = spark.createDataFrame([(1, ["a", "b", "c"]), (1, ["c", "a", "b"]), (1, ["a", "b"])], "doc_id long, tokens array<string>")
    ph = spark.createDataFrame([("a", "b")], "a string, b string")
    got = sorted(r.tokens for r in T.apply_phrases(td, ph).collect())
    assert got == [["a_b"], ["a_b", "c"], ["c", "a_b"]]


def test_word_vectors_of_every_distinct_word(spark):
    rows, td = corpus(spark)
    got = [r.word for r in T.distinct_words(td).where("word is not null").collect()]
    assert sorted(got) == sorted({w for _, t in rows for w in t or [] if w is not None})
