"""Every stage against its own rule, worked out anew on the rows it was given."""

from collections import defaultdict

import corpus_pipeline as C
from tidings.llm import mixing, simhash
from tidings.llm.common import documents, stage
from tidings.session import read_table

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs, seen = documents(spark, SF), []
    for i, (_, fn) in enumerate(C.STAGES):
        out = stage(fn(spark, docs, SF), "test")
        if i + 1 < len(C.STAGES):
            assert out.columns == docs.columns
        seen.append((docs.collect(), out.collect()))
        docs = out
    (a0, a1), (b0, b1), (c0, c1), (d0, d1), (e0, e1) = seen

    truth = {r.doc_id: r.quality for r in read_table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in a1}
    clean = [r.doc_id for r in a0 if truth.get(r.doc_id) == 1]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean) and len(a1) < len(a0)
    junk = [r.doc_id for r in a0 if truth.get(r.doc_id) == 0]
    assert sum(d in kept for d in junk) <= 0.2 * len(junk)

    last = {}
    for r in b0:
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert sorted(r.doc_id for r in b1) == sorted(last.values())

    fps = [simhash.fingerprint(r.text) & (2 ** 64 - 1) for r in c0]
    root = list(range(len(c0)))
    for i in range(len(c0)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    low = defaultdict(lambda: 2 ** 62)
    for r, c in zip(c0, root):
        low[c] = min(low[c], r.doc_id)
    assert sorted(r.doc_id for r in c1) == sorted(low.values())

    words = lambda rows: sum(len((r.text or "").encode().split()) for r in rows)
    assert words(d1) == mixing.mix(spark.createDataFrame(d0, documents(spark, SF).schema)).selectExpr(
        "sum(taken)").first()[0]
    text = {r.doc_id: r.text for r in d0}
    assert all(text[r.doc_id] == r.text or text[r.doc_id].split()[:len(r.text.split())] == r.text.split() for r in d1)

    used = defaultdict(list)
    for r in e1:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.piece == 0 for r in e1) == len(e0)


def test_run_is_the_stages(spark):
    rows = C.run(spark, SF).collect()
    assert rows and set(C.queries()) == {"pipeline"} and C.oracle_sql() == {}


def test_awkward_rows_pass_all_stages(spark, docs, tmp_path):
    """Nulls, empty and long texts, copies, repeated rows, another column."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    read_table(spark, SF, "labels").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    rows = C.run(spark, str(tmp_path)).collect()
    found = {r.doc_id for r in rows}
    # copies: 2 stays of 1 and 2, 8 of 7 and 8; 3, 4 and 6 have no words
    assert found == {2, 5, 8, None}
    assert sum(r.doc_id == 5 for r in rows) > 100


def test_empty_tables(spark, no_docs, tmp_path):
    for name in ("documents", "labels"):
        read_table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert C.run(spark, str(tmp_path)).collect() == []
