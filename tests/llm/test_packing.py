import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidings.llm import packing as P
from tidings.llm.common import documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, docs, tokenizer, size):
    """Pieces are the documents' ids cut as stated; sequences are gapless."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id), []).append(r)
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        got = sorted(by_doc[doc_id], key=lambda r: r.piece)
        cuts = list(range(len(ids) % size or size, len(ids) + 1, size))
        want = list(itertools.pairwise([0, *cuts]))
        assert [(r.piece, r.start, r.length) for r in got] == [(i, a, b - a) for i, (a, b) in enumerate(want)]
        assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(ids[a:b], "<u4").tobytes()) for a, b in want]
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r.length for r in rows)
    return len(bins), -(-total // size)


def test_documents(spark, tokenizer):
    docs = documents(spark, SF)
    bins, least = check(P.pack_documents(docs).collect(), docs.select("doc_id", "text").collect(), tokenizer, 2048)
    assert bins <= least * 1.002 + 1


def test_small_sequences(spark, tokenizer):
    docs = documents(spark, SF)
    rows = P.pack_documents(docs, sequence=64).collect()
    bins, least = check(rows, docs.select("doc_id", "text").collect(), tokenizer, 64)
    assert bins <= least * 1.002 + 1


def encoder():
    return P._encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(st.sampled_from("aB1é.,'s \n\t  \x01\x1c\x85\u2028\u3000<|>中ß½٣ "), max_size=40), st.text(max_size=40),
                 st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "bc.", "\n", "it's", "  ", "I'LL"]), max_size=12).map("".join)))
def test_ranks_give_the_tokenizers_ids(tokenizer, text):
    assert encoder().encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_special_token_is_the_tokenizers_own(tokenizer):
    got = encoder().encode("a <|endoftext|> b").tolist()
    assert got == [64, 220, 50256, 275] == tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids


@pytest.mark.parametrize("unit", ["a", " ", "ab1", "é", "\n", "x ", "=-"])
def test_long_stretches(tokenizer, unit):
    text = "start " + unit * 60_000 + " end"
    assert encoder().encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_whole_tables_by_the_tokenizer_alone(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    fast, slow = P.token_pieces(docs), P.token_pieces(docs, ranks=None)
    assert fast.exceptAll(slow).count() == 0 and slow.count() == fast.count()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=5), st.integers(0, 14))
def test_fullest_equals_brute_force(avail, room):
    best = max((s for take in itertools.product(*[range(n + 1) for n in avail.values()])
                if (s := sum(k * t for k, t in zip(avail, take))) <= room), default=0)
    got = P.fullest(avail, room)
    assert sum(k * v for k, v in got.items()) == best
    assert all(v <= avail[k] for k, v in got.items())


def test_one_hot_length_is_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(P, "RANK_ROWS", 7)
    rows = [(i, 0, 0, 3 if i % 3 else 5, i) for i in range(200)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = P.pack(pieces, 16).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 200
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 16 and len(used) <= -(-sum(r[3] for r in rows) // 16) + 1


def test_sequences_hold_the_ids(spark, tokenizer):
    docs = documents(spark, SF).limit(20)
    packed = P.pack_documents(docs, with_ids=True)
    assert sum(len(r.ids) for r in P.sequences(packed).collect()) == sum(r.length for r in packed.collect())


def test_awkward_rows(docs):
    got = P.pack_documents(docs).collect()
    assert sorted({str(r.doc_id) for r in got}) == sorted({str(r.doc_id) for r in docs.collect()})
    assert sum(r.length == 1 for r in got) >= 3
    assert len([r for r in got if r.doc_id == 2]) == 2


def test_empty(no_docs):
    assert P.pack_documents(no_docs).collect() == []
