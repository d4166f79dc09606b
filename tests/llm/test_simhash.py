import numpy as np
import pytest
import xxhash

from tidings.llm import simhash as S
from tidings.llm.common import documents

SF_SMALL = "/root/testdata/sf0.001"


def brute_fp(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, max_bits):
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= max_bits and root[i] != root[j]:
                    root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
                    changed = True
    return root


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, f - 2 ** 64 if f >= 2 ** 63 else f, 0) for i, f in enumerate(rows)],
                               "id long, fp long, key long")
    got = {r.id: r.component for r in S.near_groups(df, 4, **options).collect()}
    assert got == dict(enumerate(brute_components(rows, 4)))


def test_fingerprints_equal_brute_force(docs):
    for r in docs.collect():
        assert S.fingerprint(r.text or "") & (2 ** 64 - 1) == brute_fp(r.text)


def test_pieces_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"w{i % 71}" for i in range(5000))
    want = S.fingerprint(text)
    monkeypatch.setattr(S, "_PIECE", 100)
    assert S.fingerprint(text) == want


@pytest.mark.parametrize("key_rows", [4096, 8])
def test_components_equal_brute_force(spark, key_rows):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2 ** 63, 40)]
    for base in list(fps[:6]):  # chains and dense groups
        for _ in range(12):
            base ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False))
            fps.append(base)
    dense = fps[0]
    fps += [dense ^ (1 << b) for b in range(40)]
    check(spark, fps, key_rows=key_rows)


def test_documents_equal_brute_force(spark):
    rows = documents(spark, SF_SMALL).select("doc_id", "text").collect()
    fps = [brute_fp(r.text) for r in rows]
    root = brute_components(fps, 4)
    low = {}
    for r, c in zip(rows, root):
        low[c] = min(low.get(c, r.doc_id), r.doc_id)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in S.query(spark, SF_SMALL).collect()}
    assert got == {(r.doc_id, f"{f:016x}", low[c]) for r, f, c in zip(rows, fps, root)}


def test_awkward_rows(docs):
    got = S.simhash_dedup(docs).collect()
    assert len(got) == docs.count()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {3}
    kept = S.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "None", "5", "7"])


def test_empty(no_docs):
    assert S.simhash_dedup(no_docs).collect() == [] and S.kept_documents(no_docs).collect() == []
