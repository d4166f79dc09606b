"""Inverted-index joins of bags of words against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidings.operators import cluster as C
from tidings.operators import sparse as SP


def vectors(n, terms, seed=0, size=6):
    """Random unit vectors; low terms are frequent."""
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        bag = {f"w{int(terms * rng.random() ** 3)}": rng.uniform(1, 3) for _ in range(rng.randint(1, size))}
        norm = sum(x * x for x in bag.values()) ** 0.5
        out[i] = {t: x / norm for t, x in bag.items()}
    return out


def frame(spark, vecs):
    return spark.createDataFrame([(i, t, w) for i, v in vecs.items() for t, w in v.items()],
                                 "id long, term string, weight double")


def dot(a, b):
    return sum(w * b.get(t, 0.0) for t, w in a.items())


@pytest.mark.parametrize("least", [0.513, 0.807, 0.951])
@pytest.mark.parametrize("block", [3, 1024])
def test_pairs_equal_brute_force(spark, least, block):
    v = vectors(150, 60)
    want = {(a, b): dot(v[a], v[b]) for a in v for b in v if a < b and dot(v[a], v[b]) >= least}
    got = {(r.a, r.b): r.dot for r in SP.pairs_above(frame(spark, v), None, least, block).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("block", [3, 1024])
def test_two_tables_equal_brute_force(spark, block):
    a, b = vectors(80, 50, 1), vectors(90, 50, 2)
    want = {(i, j) for i in a for j in b if dot(a[i], b[j]) >= 0.703}
    assert {(r.a, r.b) for r in SP.pairs_above(frame(spark, a), frame(spark, b), 0.703, block).collect()} == want


def test_few_candidates(spark):
    """One frequent word in every vector: all pairs share it, few are candidates."""
    v = {i: {"the": 0.5, f"x{i // 2}": 0.75 ** 0.5} for i in range(400)}
    rows = frame(spark, v)
    assert SP.candidate_pairs(rows, None, 0.8).count() == 200
    assert SP.pairs_above(rows, None, 0.8).count() == 200
    freq = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    index = SP.prefixes(rows, freq, 0.8, rows.count())
    assert index.count() == 400 and index.where("term = 'the'").count() == 0


def test_classes_of_copies_and_articles_without_words(spark):
    v = {i: {"a": 0.6, "b": 0.8} if i < 50 else {f"c{i}": 1.0} for i in range(60)}
    ids = spark.range(62)
    pairs, member = SP.similar_classes(frame(spark, v), 0.2, ids=ids)
    got = {r.id: r.rep for r in member.collect()}
    assert pairs.count() == 0 and got == {i: 0 if i < 50 else i for i in range(62)}


def test_near_rows_of_copies(spark):
    v = {i: {"a": 1.0} if i < 30 else {"a": 0.8, "b": 0.6} for i in range(40)}
    rows = frame(spark, v)
    got = [(r.id, r.nid, r.rank) for r in SP.near_rows(rows.where("id = 35"), rows, 12, 0.5).collect()]
    assert sorted(got, key=lambda r: r[2]) == [(35, n, k) for k, n in enumerate([*range(30, 40), 0, 1], 1)]


def test_central_equals_brute_force(spark):
    v = vectors(120, 40, 5)
    labels = {i: i % 9 for i in range(124)}  # 120..123 have no word
    got = {r.label: r.id for r in SP.central(frame(spark, v), spark.createDataFrame(
        list(labels.items()), "id long, label long"), block=4).collect()}
    for lab in range(9):
        own = [v.get(i, {}) for i, x in labels.items() if x == lab]
        mean = {}
        for x in own:
            for t, w in x.items():
                mean[t] = mean.get(t, 0.0) + w / len(own)
        score = {i: round((1 - 2 * dot(v[i], mean)) if i in v else 0.0, 9) for i in labels}
        assert got[lab] == min(score, key=lambda i: (score[i], i))


@pytest.mark.parametrize("method", ["complete", "dbscan"])
def test_groups_equal_those_of_dense_vectors(spark, method):
    v = vectors(40, 25, 7, size=3)
    terms = sorted({t for x in v.values() for t in x})
    dense = spark.createDataFrame([(i, [float(x.get(t, 0.0)) for t in terms]) for i, x in v.items()] + [
        (40, [0.0] * len(terms)), (41, [0.0] * len(terms))], "id long, vec array<double>")
    news = spark.range(42)
    got = C.group_news(news, None, 1, 0.3, method, bags=frame(spark, v)).collect()
    want = C.group_news(news, dense, 1, 0.3, method).collect()
    assert sorted((r.id, r.group) for r in got) == sorted((r.id, r.group) for r in want)
    # (the two members of a pair are equally central: rounding decides among dense ones)
    assert {r.group for r in got if r.is_central_news} == {r.group for r in got} - {-1}


@pytest.mark.parametrize("two", [False, True])
def test_candidates_meet_in_blocks(spark, monkeypatch, two):
    """Vectors go to blocks and not to candidates: no join has more bags on its
    way than vectors times blocks; pairs are those of brute force."""
    monkeypatch.setattr(SP, "GROUP_PAIRS", 200)
    monkeypatch.setattr(SP, "GROUP_TERMS", 150)
    monkeypatch.setattr(SP, "CHUNK_TERMS", 16)
    a, b = vectors(150, 40, 3), vectors(120, 40, 4)
    want = ({(i, j): dot(a[i], b[j]) for i in a for j in b if dot(a[i], b[j]) >= 0.513} if two else
            {(i, j): dot(a[i], a[j]) for i in a for j in a if i < j and dot(a[i], a[j]) >= 0.513})
    found = SP.pairs_above(frame(spark, a), frame(spark, b) if two else None, 0.513)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "map_from_entries" not in plan
    got = {(r.a, r.b): r.dot for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_central_adds_up_a_mean_once(spark, monkeypatch):
    """No frame reaches to a label's last term: it would be added up anew for each
    of its terms, which is quadratic in the words of a label."""
    plans, cut = [], SP.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)
    monkeypatch.setattr(SP, "cut_lineage", seen)
    v = vectors(40, 30, 6)
    labels = spark.createDataFrame([(i, i % 3) for i in v], "id long, label long")
    got = {r.label: r.id for r in SP.central(frame(spark, v), labels).collect()}
    mean = {m: {} for m in range(3)}
    for i, bag in v.items():
        for t, w in bag.items():
            mean[i % 3][t] = mean[i % 3].get(t, 0.0) + w / sum(j % 3 == i % 3 for j in v)
    assert got == {m: min(v, key=lambda i: (round(1 - 2 * dot(v[i], mean[m]), 12), i)) for m in mean}
    assert any("windowspecdefinition" in p for p in plans) and not any("unboundedfollowing" in p for p in plans)
