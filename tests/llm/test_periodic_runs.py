import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidings.llm import periodic_runs as R
from tidings.llm.common import documents
from tidings.llm.words import words_of

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    """Every run by its definition: for each period the maximal stretches, of
    equal stretches the smallest period."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p:
                best.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in best.items() if e - s >= max(least, 2 * p))


def found(*docs, least=12):
    sizes = np.array([len(d) for d in docs])
    flat = [x for i, d in enumerate(docs) for x in [*d, 10 ** 6 + i]]
    s, e, p = R.find_runs(np.array(flat, np.int64), sizes, least)
    return sorted(zip(s.tolist(), (e - s).tolist(), p.tolist()))


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(0, k), max_size=120)), st.integers(2, 14))
def test_random_words_equal_brute_force(words, least):
    assert found(words, least=least) == brute(words, least)


@st.composite
def powers(draw):
    """Words made of powers of words, whose blocks are powers themselves."""
    word = draw(st.lists(st.integers(0, 2), min_size=1, max_size=4))
    for _ in range(draw(st.integers(1, 3))):
        word = word * draw(st.integers(1, 9)) + draw(st.lists(st.integers(0, 2), max_size=5))
        if draw(st.booleans()):
            word = word + word[:draw(st.integers(0, len(word)))]
    return word[:700]


@settings(max_examples=400, deadline=None)
@given(powers(), st.integers(0, 3))
def test_powers_of_powers_equal_brute_force(words, cut):
    assert found(words[cut:]) == brute(words[cut:])


@pytest.mark.parametrize("k", [5, 12, 30, 70])
def test_touching_periodic_regions(k):
    """(ab)^k a a (ba)^k: no member near the middle, yet a run for every odd period."""
    words = [0, 1] * k + [0, 0] + [1, 0] * k
    got = found(words)
    assert got == brute(words) and len(got) > k // 2


def test_long_periods():
    rng = np.random.default_rng(3)
    for p in (11, 22, 23, 47, 100, 333, 1000):
        block = rng.integers(0, 50, p).tolist()
        words = rng.integers(0, 50, 37).tolist() + block * 2 + block[:p // 3] + rng.integers(0, 50, 41).tolist()
        assert found(words) == brute(words)
        assert any(q == p for _, _, q in found(words))


def test_documents_do_not_touch():
    a, b = [1, 2, 3] * 3, [1, 2, 3] * 9
    assert found(a, a, b, a) == [(len(a) * 2 + 2, 27, 3)]


def test_members_are_consistent_and_dense():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 3, 4000)
    names = R._joined(codes.astype(np.uint64), codes.astype(np.uint64))
    for length in (1, 2, 4):
        names = R._joined(names[:-length], names[length:])
    t = 8
    quiet = np.array([any((codes[i:i + t - q] == codes[i + q:i + t]).all() for q in (1, 2)) for i in range(len(names))])
    at = set(R.members(names, t, quiet).tolist())
    by_context = {}
    for i in range(len(codes) - 2 * t + 1):
        assert by_context.setdefault(tuple(codes[i:i + 2 * t]), i in at) == (i in at)
        window = codes[i:i + 3 * t - 1]
        if len(window) == 3 * t - 1:
            dull = any((window[q:] == window[:-q]).all() for q in (1, 2))
            assert dull != any(j in at for j in range(i, i + t))


def expected(doc_id, text):
    words = R.planted(doc_id, words_of((text or "").encode()))
    runs = brute(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    sha = [hashlib.sha256(x).hexdigest() for x in (lines.encode(), kept)]
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], *sha)


def test_query_equals_brute_force(spark):
    rows = documents(spark, SF).where("length(text) < 9000").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in R.query(spark, SF).collect()}
    assert len(got) == documents(spark, SF).count()
    for r in rows:
        assert got[r.doc_id] == expected(r.doc_id, r.text)


def test_planted_words_follow_the_rule():
    words = [str(i).encode() for i in range(50)]
    for i in range(200):
        h, got = zlib.crc32(str(i).encode()), R.planted(i, words)
        a, g = (h // 10) % 50, h // 10
        p = 1 + (50 - a) // (3 + g % 8)
        assert got == ([words[k if k < a else a + (k - a) % p] for k in range(50)] if h % 10 == 0 else words)


def test_awkward_rows(docs):
    got = R.periodic_runs(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].runs == [] and by_id[3].collapsed == "" and by_id[4].n_words == 0 and by_id[6].n_words == 0
    long = by_id[5]
    assert [tuple(r) for r in long.runs] == [(0, 400_000, 1)] and long.collapsed == "Word"
    assert [r.n_words for r in got if r.doc_id == 2] == [12, 12]


def test_empty(no_docs):
    assert R.periodic_runs(no_docs).collect() == []
