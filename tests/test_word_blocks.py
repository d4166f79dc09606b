"""Word vectors meet documents in blocks: the vectors that travel, and the
results against the plain form for repeated and missing ids and words."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidings.operators import text as T


def corpus(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, [words[j] for j in rng.zipf(1.4, 30) % 60]) for i in range(80)]
    rows += [(3, ["w1", "w2", "w2"]), (None, ["w1", "w9"]), (None, None), (90, []), (91, None), (92, ["none", "here"])]
    vecs = [(w, [float(x) for x in rng.normal(size=4)]) for w in words[:50]] + [("w1", [1.0, 0.0, 0.0, 2.0]), ("w51", None),
                                                                               ("w52", [0.0] * 4)]
    td = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(5)
    return rows, vecs, td, spark.createDataFrame(vecs, "word string, vec array<float>")


def occurrences(rows, vecs):
    """doc_id -> (word, pos, unit vector) of all known occurrences."""
    of_word = {}
    for w, v in vecs:
        if v is not None:
            x = np.array(v, np.float32).astype(float)
            of_word.setdefault(w, []).append(x / (np.sqrt((x * x).sum()) or 1.0))
    out = {}
    for i, tokens in rows:
        for p, w in enumerate(tokens or []):
            if i is not None:
                out.setdefault(i, []).extend((w, p, u) for u in of_word.get(w, []))
    return out


def test_blocks_equal_the_plain_form(spark):
    rows, vecs, td, wv = corpus(spark)
    occ = occurrences(rows, [v for v in vecs if v[0] not in ("w51",)])
    for size in (40, 10_000):
        got = [(r.doc_id, r.dvec) for r in T.doc_vector(td.where("not exists(tokens, x -> x = 'w51')"), wv, 4, size).collect()]
        free = [(i, t) for i, t in rows if t is not None and "w51" not in t]
        known = occurrences(free, vecs)
        assert sorted(str(i) for i, _ in got) == sorted(str(i) for i, _ in free)
        for i, v in got:
            want = np.mean([u for _, _, u in known[i]], axis=0) if known.get(i) else np.zeros(4)
            assert np.allclose(v, want, atol=1e-12)
        kw = sorted(((r.doc_id, r.keywords) for r in T.keywords(td, wv, 4, 5, size).collect()), key=str)
        want = []
        for i, tokens in rows:
            found = tokens
            if occ.get(i):
                mean = np.mean([u for _, _, u in occ[i]], axis=0)
                cos = [(-round(float(u @ mean) / np.sqrt(mean @ mean), 12), -p, w) for w, p, u in occ[i]]
                found = sorted({w for _, _, w in sorted(cos)[:5]})
            want.append((i, found))
        assert kw == sorted(want, key=str)


def test_a_vector_travels_once_per_block_and_word(spark):
    """40 documents of the same 30 words are 30 rows of vectors, not 1,200."""
    td = spark.createDataFrame([(i, [f"w{j}" for j in range(30)]) for i in range(40)], "doc_id long, tokens array<string>")
    wv = spark.createDataFrame([(f"w{j}", [float(j), 1.0]) for j in range(30)], "word string, vec array<float>")

    def kernel(counts, words):
        return pa.table({"counts": pa.array([counts.num_rows]), "vectors": pa.array([words.num_rows])})
    n = [F.count("pos").alias("n")]
    got = T._with_vectors(td, wv, n, kernel, "counts long, vectors long", 10_000)[1].collect()
    assert [(r.counts, r.vectors) for r in got] == [(1200, 30)]
    many = T._with_vectors(td, wv, n, kernel, "counts long, vectors long", 300)[1].collect()
    assert sum(r.counts for r in many) == 1200 and len(many) > 1 and all(r.vectors == 30 for r in many)
