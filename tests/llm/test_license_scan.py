import random
import re

import pytest

from tidings.llm import license_scan as L
from tidings.llm.common import documents

SF = "/root/testdata/sf0.001"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        got = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        at += got
        labels |= {label} if got else set()
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))


def check(rows, table):
    want = sorted((str(d), *map(str, brute(t))) for d, t in table)
    got = sorted((str(r.doc_id), *map(str, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)))
                 for r in rows)
    assert got == want
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_documents_equal_brute_force(spark):
    docs = documents(spark, SF)
    check(L.scan_licenses(docs).collect(), docs.select("doc_id", "text").collect())


def test_random_words_equal_brute_force(spark):
    rng = random.Random(6)
    pool = "under the mit license apache version 2 cc by nc x".split()
    rows = [(i, rng.choice(["", " ", "-", "é "]).join([""]) + rng.choice([" ", ", ", "\n", "-"]).join(
        rng.choice(pool) for _ in range(rng.randint(0, 300)))) for i in range(120)]
    rows.append((500, "under the mit license " * 4000))
    check(L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


@pytest.mark.parametrize("label,notice,keys", L.NOTICES)
def test_notices_are_found_and_need_their_keys(spark, label, notice, keys):
    index = L.RareTokenIndex(L.templates(), {}, 1)
    filler = " some words of prose stand here "
    words = notice.split()
    words[len(words) // 2] += ", "
    assert label in index.scan(filler + " ".join(words).upper() + filler)[5].split(",")
    broken = notice
    for k in keys:
        broken = broken.replace(k.split()[-1], "zzz")
    assert label not in index.scan(filler + broken + filler)[5].split(",")
    shuffled = notice.split()
    random.Random(1).shuffle(shuffled)
    assert not set(index.scan(filler + (" filler" * 9 + " ").join(shuffled))[5].split(",")) & {"gpl", "bsd", "isc"}


def test_frequencies_cover_all_documents(spark, docs):
    of = L.templates()
    counts, n = L.document_frequencies(docs, of)
    assert n == docs.count() and counts[b"the"] == 3


def test_awkward_rows(docs):
    check(L.scan_licenses(docs).collect(), docs.select("doc_id", "text").collect())


def test_empty(no_docs):
    assert L.scan_licenses(no_docs).collect() == []
