import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidings.llm import mixing as M
from tidings.llm.common import documents

SF = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        level = left / free if free else 0
        more = {s for s in names if s not in capped and cap * sizes[s] < w[s] * level}
        if not more:
            return {s: cap * sizes[s] if s in capped else w[s] * level for s in names}
        capped |= more


def check(rows, docs):
    sizes = defaultdict(int)
    per_doc = {}
    for d, text, source in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        per_doc.setdefault((d, n), source)
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        source = per_doc[(r.doc_id, r.size)]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5001


@pytest.mark.parametrize("block", [2048, 7])
def test_words_taken_meet_the_targets(spark, block):
    docs = documents(spark, SF)
    rows = M.mix(docs, block=block).collect()
    check(rows, docs.select("doc_id", "text", "source").collect())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix(docs, block=block).collect()))


def test_bounded_groups_change_nothing(spark, monkeypatch):
    docs = documents(spark, SF)
    want = sorted(map(tuple, M.mix(docs, block=50).collect()))
    monkeypatch.setattr(M, "GROUP_ROWS", 3)
    monkeypatch.setattr(M, "RUN_SLOTS", 11)
    assert sorted(map(tuple, M.mix(docs, block=50).collect())) == want


def test_points(spark):
    got = [r.p for r in spark.range(64).select(M.van_der_corput(F.col("id")).alias("p")).collect()]
    assert got == [int(f"{i:064b}"[::-1], 2) / 2 ** 64 for i in range(64)]


def test_schedule_is_even(spark):
    """Every window of slots holds nearly each source's share."""
    src = spark.createDataFrame([(0, "a", 1, 9000, 5000.0), (1, "b", 1, 1000, 3000.0), (2, "c", 1, 4000, 2000.0)],
                                "sid long, source string, rows long, source_size long, target double")
    slots = M.schedule(src, 10).orderBy("position").collect()
    assert {s: sum(r.words for r in slots if r.sid == s) for s in range(3)} == {0: 5000, 1: 3000, 2: 2000}
    for at in range(0, len(slots) - 100, 37):
        for s, share in enumerate((.5, .3, .2)):
            assert abs(sum(r.sid == s for r in slots[at:at + 100]) - 100 * share) <= 8


def test_awkward_rows(docs):
    rows = M.mix(docs).collect()
    assert len(rows) == docs.count()
    check(rows, docs.select("doc_id", "text", "source").collect())


def test_mixed_documents_hold_the_taken_words(spark, docs):
    for table in (docs, documents(spark, SF)):
        got = M.mixed_documents(table)
        assert got.columns == table.columns
        want = M.mix(table).agg(F.sum("taken")).first()[0]
        assert got.select(F.sum(M.n_words(F.col("text")))).first()[0] == want


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("block", [2048, 25])
def test_the_mix_in_order_holds_the_texts(spark, block):
    """Blocks rebuilt from the texts: every slot holds the stream's words, with
    the white space as it stands, and all documents together what mix takes."""
    docs = documents(spark, SF).where("doc_id < 80")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = M.mixed_texts(docs, block=block).collect()
    taken = defaultdict(int)
    slots = defaultdict(list)
    for r in rows:
        own = words(text[r.doc_id])[r.in_doc:r.in_doc + r.taken]
        assert words(r.text) == own and r.text in text[r.doc_id]
        taken[r.doc_id] += r.taken
        slots[r.position, r.sid, r.epoch, r.block].append(r)
    assert taken == {r.doc_id: r.taken for r in M.mix(docs, block=block).where("taken > 0").collect()}
    for key, parts in slots.items():  # gapless from 0
        at = 0
        for r in sorted(parts, key=lambda r: r.in_block):
            assert r.in_block == at
            at += r.taken
        assert at <= block


def test_parts_keep_their_white_space_and_sources_stay_apart(spark):
    rows = [(1, "a  b\n\tc d", "x"), (1, "a  b\n\tc d", "y"), (2, "e", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [r[0] for r in d.select(M.words_between(F.col("text"), F.lit(1), F.lit(2))).collect()][:2] == ["b\n\tc"] * 2
    got = M.mixed_documents(d)
    assert got.select(F.sum(M.n_words(F.col("text")))).first()[0] == M.mix(d).agg(F.sum("taken")).first()[0]
    for r in got.collect():
        assert any(t.startswith(r.text) and s == r.source for _, t, s in rows)
    by_source = {r.source: r.n for r in got.groupBy("source").agg(F.sum(M.n_words(F.col("text"))).alias("n")).collect()}
    assert set(by_source) == {"x", "y"}


def test_empty(no_docs):
    assert M.mix(no_docs).collect() == [] and M.mixed_documents(no_docs).collect() == []
