import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidings.llm import ngram_lm as M
from tidings.llm.common import documents
from tidings.llm.elias_fano import EliasFano, Level
from tidings.llm.words import words_of

SF = "/root/testdata/sf0.001"


def brute(docs, order=M.ORDER, strength=M.STRENGTH, least=M.LEAST_CONTEXT):
    """The model over plain dictionaries, quantised level by level."""
    texts = [(i, t, ["<", *words_of((x or "").encode(), lower=True), ">"]) for i, x, t in docs]
    count = Counter()
    for _, train, w in texts:
        if train:
            for k in range(1, order + 1):
                count.update(tuple(w[j:j + k]) for j in range(len(w) - k + 1))
    begins = count[("<",)]
    n = sum(c for g, c in count.items() if len(g) == 1) - begins
    v = sum(len(g) == 1 for g in count) - (begins > 0)
    q = lambda p: int(M.quantise(np.array([p]))[0])

    def code(gram):
        if len(gram) == 1:
            return q((count[gram] + 1) / (n + v + 1))
        seen = count[gram[:-1]]
        shorter = code(gram[1:])
        if seen < (least if len(gram) > 2 else 1):
            return shorter
        return q((count[gram] + strength * float(M.probability(np.array(shorter)))) / (seen + strength))

    out = []
    for i, train, w in texts:
        mine = [tuple(w[max(0, j - order + 1):j + 1]) for j in range(1, len(w))]
        known = sum(count[(x,)] > 0 for x in w[1:])
        base = sum(math.log10((count[(x,)] + 1) / (n + v + 1)) for x in w[1:])
        out.append((i, train, len(w) - 1, known, n, base, sum(code(g) for g in mine) / -M.STEPS))
    return out


def check(got, want):
    key = lambda r: (str(r[0]), *map(str, r[1:4]), round(r[5], 4), round(r[6], 4))
    got = sorted(((r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_documents_equal_brute_force(spark, order):
    docs = documents(spark, SF).where("doc_id < 60")
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in docs.collect()]
    check(M.score(docs, train, order=order).collect(), brute(rows, order))


def test_small_blocks_many_shards_and_split_contexts(spark, monkeypatch):
    """Long texts in parts, hot words over several shards: the same scores."""
    import sys
    monkeypatch.setattr(sys.modules["tidings.llm.ngram_lm"], "SHARD_NGRAMS", 100)
    rows = [(i, " ".join(f"the w{(i * j) % 13} of" for j in range(40 + i)), i % 3 != 0) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    check(M.score(d, F.col("train")).collect(), brute([(i, x, t) for i, x, t in rows]))


@pytest.mark.parametrize("block,split", [(7, 5), (50, 20), (1000, 3)])
def test_blocks_alone(monkeypatch, block, split):
    """Blocks, shards and answers without Spark, with every limit small."""
    monkeypatch.setattr(M, "BLOCK_TOKENS", block)
    monkeypatch.setattr(M, "SPLIT", split)
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(list("abcdeXy"), int(rng.integers(0, 60)))), bool(rng.integers(0, 3))) for i in range(30)]
    check(run_alone(docs, shards=3), brute(docs))


def run_alone(docs, shards, order=M.ORDER):
    """The exchange between blocks and shards, in plain loops."""
    import types as t

    import pyarrow as pa
    made = []

    class Rows:
        def select(self, *a):
            return self

        def mapInArrow(self, fn, schema):
            batch = pa.record_batch([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[2] for d in docs]),
                                     pa.array([d[1] for d in docs], pa.string())], names=["i", "train", "text"])
            made.extend(x for b in fn(iter([batch])) for x in b.to_pylist())

    class Context:
        def partitionId(self):
            return 0
    old, M.TaskContext = M.TaskContext, t.SimpleNamespace(get=Context)
    old_f, M.F = M.F, t.SimpleNamespace(col=lambda *a: Column(), coalesce=lambda *a: Column(), lit=lambda *a: None)
    old_text, M.text_of = M.text_of, lambda *a: Column()
    try:
        M.blocks_of(Rows(), None, order)
    finally:
        M.TaskContext, M.F, M.text_of = old, old_f, old_text
    blocks = [M.Block(r) for r in made]
    n_docs = sum(r["n_train"] for r in made)

    def exchange(asked, level):
        by_shard = {}
        for k, (shard, payload) in asked:
            by_shard.setdefault(shard, []).append((k, payload))
        answers = [{} for _ in blocks]
        totals = [0, 0]
        for shard, rows in by_shard.items():
            table = pa.table({"shard": [shard] * len(rows), "block": [k for k, _ in rows], "payload": [p for _, p in rows]})
            for r in level(table).to_pylist():
                if r["block"] is None:
                    totals = [totals[0] + r["tokens"], totals[1] + r["types"]]
                else:
                    answers[r["block"]][shard] = r["payload"]
        return answers, totals

    answers, (n, v) = exchange([(k, a) for k, b in enumerate(blocks) for a in b.ask_words(2)], M.word_level(2))
    n, v = n + n_docs, v + (n_docs > 0)
    for b, a in zip(blocks, answers):
        b.learn_words(a, 2, shards, n_docs, n, v)
    for level in range(2, order + 1):
        for b in blocks:
            b.n_grams(level)
        answers, _ = exchange([(k, a) for k, b in enumerate(blocks) for a in b.ask()],
                              M.n_gram_level(level, level == order, M.STRENGTH, M.LEAST_CONTEXT))
        for b, a in zip(blocks, answers):
            b.learn(a, level == order)
    whole, parts = [], {}
    for b in blocks:
        for r in b.scores(n, v):
            if r[1] is None:
                whole.append(r)
            else:
                parts.setdefault(r[1], []).append(r)
    whole += [(*p[0][:3], *map(sum, zip(*[r[3:] for r in p]))) for p in parts.values()]
    return [t.SimpleNamespace(doc_id=r[0], train=r[2], n_tokens=r[3], n_known=r[4], train_tokens=n, base_score=r[5], score=r[6])
            for r in whole]


class Column:
    def alias(self, *a):
        return self

    cast = alias


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2 ** 60), max_size=60), st.lists(st.integers(0, 2 ** 60), max_size=20), st.integers(0, 58))
def test_sequences(values, asked, shift):
    v = np.sort(np.array(values, np.int64) >> shift)
    e = EliasFano.of(v)
    assert e[np.arange(len(v))].tolist() == v.tolist()
    x = np.concatenate([np.array(asked, np.int64) >> shift, v])
    assert e.successor(x).tolist() == np.searchsorted(v, x).tolist()


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 30), st.integers(1, 40)), st.integers(0, 255), max_size=80))
def test_levels(tmp_path_factory, children):
    keys = sorted(children)
    c, w = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
    path = tmp_path_factory.getbasetemp() / "level"
    path.write_bytes(Level.of(c, w, np.array([children[k] for k in keys])).to_bytes())
    level = Level.map(str(path))
    every = [(a, b) for a in range(32) for b in range(42)]
    found = level.find(np.array([a for a, _ in every]), np.array([b for _, b in every]))
    assert found.tolist() == [keys.index(k) if k in children else -1 for k in every]
    assert level.codes.tolist() == [children[k] for k in keys]


def test_a_level_is_compact():
    rng = np.random.default_rng(0)
    key = np.unique(rng.integers(0, 2000, 200_000) * (1 << 20) + rng.integers(1, 1 << 17, 200_000))
    level = Level.of(key >> 20, key & (1 << 20) - 1, np.zeros(len(key)))
    assert len(level.to_bytes()) < 3.2 * len(key)  # pairs of plain numbers take 16 bytes, and the code one


def test_numbers_survive_packing():
    for a in (np.array([], np.int64), np.array([1, 2 ** 40, -5]), np.arange(300, dtype=np.uint8)):
        got, other = M.unpack(M.pack(a, a[:1]))
        assert got.dtype == a.dtype and got.tolist() == a.tolist() and other.tolist() == a[:1].tolist()


def test_the_model_predicts_held_out_text(spark):
    r = M.query(spark, "/root/testdata/sf0.01").where("held_out").agg(
        F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert r["score"] > 0.97 * r["base"]


def test_awkward_rows(docs):
    got = M.score(docs, F.coalesce(F.col("doc_id") != 8, F.lit(True))).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].n_tokens == 400_001 and by_id[3].n_tokens == by_id[4].n_tokens == by_id[6].n_tokens == 1
    assert not by_id[8].train and by_id[8].n_known == 2
    want = brute([(r.doc_id, r.text, r.doc_id != 8) for r in docs.collect()])
    check(got, want)


def test_without_training_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in M.score(d, F.lit(False)).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].score == got[1].base_score == 0 and got[2].n_tokens == 1


def test_empty(no_docs):
    assert M.score(no_docs, F.lit(True)).collect() == []


def test_distinct_is_unique_with_places():
    rng = np.random.default_rng(3)
    for key in (np.empty(0, np.int64), np.array([7, 7]), rng.integers(0, 50, 1000), rng.integers(0, 1 << 62, 1000) // 3 * 3):
        for got, want in zip(M.distinct(key), np.unique(key, return_index=True, return_inverse=True)):
            assert got.tolist() == want.tolist()


def test_pack_keeps_kinds_and_leaves_empty_planes_out():
    arrays = [np.arange(5), np.array([-3, 1 << 40]), np.empty(0, np.int32), np.array([255, 256], np.int32), np.array([0, 255], np.uint8)]
    for got, a in zip(M.unpack(M.pack(*arrays)), arrays):
        assert got.dtype == a.dtype and got.tolist() == a.tolist()
    assert b" |u1 5 " in M.pack(np.arange(5))


def test_words_are_hashed_once_a_block(spark, monkeypatch):
    """Every level hashed all words of a block again; now the block keeps them by hash."""
    docs = spark.createDataFrame([(i, f"a{i} b{i % 7} c") for i in range(200)], "doc_id long, text string")
    row = M.blocks_of(docs.coalesce(1), F.lit(True)).first().asDict()
    block, calls = M.Block(row), []
    crc = M.zlib.crc32
    monkeypatch.setattr(M.zlib, "crc32", lambda w: calls.append(w) or crc(w))
    asked = dict(block.ask_words(4))
    assert len(calls) < block.row["n_words"]
    assert [crc(w) * 4 >> 32 for w in block.words()] == sorted(crc(w) * 4 >> 32 for w in block.words())
    words = [w for s in range(4) if str(s) in asked for w in M._cut(asked[str(s)])[1]]
    assert words == block.words()
