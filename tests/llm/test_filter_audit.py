import itertools
import re

import pytest

from tidings.llm import filter_audit as A

SF = "/root/testdata/sf0.001"


def brute(docs, labels):
    """The audit by applying every order to the list of documents."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}

    def failed(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        out += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        return out + "E" * (i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs))

    rows = [(i, p or "", failed(i, t or "")) for i, t, p in docs]
    out = {}
    for part in {p for _, p, _ in rows}:
        here = [(i, f) for i, p, f in rows if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        mine = {}
        for order in itertools.permutations("ABCDE"):
            alive = here
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in alive if x in f]
                alive = [(i, f) for i, f in alive if x not in f]
                shapley[x] += len(gone)
                mine["".join(order), step] = (
                    x, len(alive), len(gone), sum(x in f for _, f in here) - len(gone), sum(f == x for _, f in here),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
        out |= {(part, *k): (*v[1:], shapley[v[0]]) for k, v in mine.items()}
    return out


def as_dict(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_small_table_equals_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long.upper(), "en"), (4, "| " * 300, "en"),
            (5, "short", "de"), (6, "short", "en"), (7, None, "de"), (8, "", None), (9, "ÄÖ É" * 90, None),
            (None, long, "en"), (None, long, "en"), (0, long + " #", "fr"), (11, "one two " * 200, "fr")]
    labels = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (5, 1, 0), (5, 0, 1), (11, 1, None), (99, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, lang string, key int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert as_dict(A.audit_documents(d, lab)) == brute(docs, [r for r in labels if r[0] is not None])


def test_two_filters(spark):
    d = spark.createDataFrame([(1, "a", "x"), (2, "a b", "x"), (3, "a b c", "x")], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = as_dict(A.audit_documents(d, lab, {"P": "words < 2", "Q": "words < 3"}))
    assert got["x", "PQ", 1] == (2, 1, 0, 0, 1, 0, 1) and got["x", "PQ", 2] == (1, 1, 1, 1, 0, 0, 3)
    assert got["x", "QP", 1] == (1, 2, 0, 1, 1, 0, 3) and got["x", "QP", 2] == (1, 0, 1, 0, 0, 0, 1)


def test_one_hot_copy_group(spark):
    docs = [(i, "same text", "en") for i in range(500)] + [(500 + i, f"t{i}", "de") for i in range(50)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = as_dict(A.audit_documents(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert got["en", "EABCD", 1][:3] == (1, 499, 0) and got["de", "EABCD", 1][:3] == (50, 0, 0)


def test_prefixes_come_from_anti_and_semi_joins(spark):
    txt = A.query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in txt and "Cartesian" not in txt


def test_awkward_rows(docs, spark):
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    got = as_dict(A.audit_documents(docs, labels))
    assert {k[0] for k in got} == {"", "en", "de", "fr", "es"} and len(got) == 5 * 600
    assert all(v[0] + v[1] <= docs.count() for v in got.values())


@pytest.mark.parametrize("empty", [True, False])
def test_empty(no_docs, spark, empty):
    labels = spark.createDataFrame([] if empty else [(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert A.audit_documents(no_docs, labels).collect() == []
