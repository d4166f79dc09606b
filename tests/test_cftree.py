"""Micro-clusters by clustering-feature trees: bounds, sums, planted groups."""

import numpy as np
import pytest

from tidings.operators import cftree as B


def blobs(n=3000, groups=20, seed=3, dims=6, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, dims)) * 5
    which = rng.integers(0, groups, n)
    return c[which] + rng.normal(scale=spread, size=(n, dims)), which


def frame(spark, x, parts=6):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>").repartition(parts)


def test_a_tree_keeps_the_bound_and_every_point():
    x, _ = blobs(1500)
    tree = B.Tree(x.shape[1], 0.3)
    of = np.array([tree.insert(1, p, float(p @ p)) for p in x])
    leaves = {e: (n, np.array(ls), ss) for e, n, ls, ss in tree.leaves()}
    assert set(leaves) == set(of.tolist()) and sum(n for n, _, _ in leaves.values()) == len(x)
    for e, (n, ls, ss) in leaves.items():
        mine = x[of == e]
        assert n == len(mine) and np.allclose(ls, mine.sum(0)) and ss == pytest.approx((mine ** 2).sum())
        assert ((mine - mine.mean(0)) ** 2).sum(1).mean() <= 0.3 ** 2 + 1e-9


@pytest.mark.parametrize("limit", [8, 100, 4096])
def test_clusters_keep_the_bound(spark, limit):
    x, _ = blobs()
    assign, summ = B.cluster_micro(frame(spark, x), 0.3, limit=limit)
    label = {r.id: r.label for r in assign.collect()}
    rows = summ.collect()
    assert sorted(label) == list(range(len(x))) and {r.label for r in rows} == set(label.values())
    for r in rows:
        mine = x[[i for i in label if label[i] == r.label]]
        assert r.n == len(mine) and min(i for i in label if label[i] == r.label) == r.label
        assert np.allclose(r.center, mine.mean(0)) and r.radius <= 0.3 + 1e-9
        assert r.radius == pytest.approx(float(np.sqrt(((mine - mine.mean(0)) ** 2).sum(1).mean())), abs=1e-6)


def test_planted_groups_are_found(spark):
    x, which = blobs()
    assign, summ = B.cluster_micro(frame(spark, x), 0.4)
    label = {r.id: r.label for r in assign.collect()}
    assert summ.count() == 20
    assert len({(label[i], which[i]) for i in range(len(x))}) == 20


def test_memory_is_bounded_by_entries(spark):
    """Far points only: every point is an entry, no tree holds more than the limit."""
    x = np.arange(500, dtype=float)[:, None] * 100
    rows = B.first_entries(frame(spark, x, 1), 0.5, limit=50).collect()
    entries = [r.entry for r in rows if r.id is None]
    assert len(entries) == len(set(entries)) == 500
    assign, summ = B.cluster_micro(frame(spark, x), 0.5, limit=50)
    assert summ.count() == assign.select("label").distinct().count() == 500


def test_one_hot_cluster_and_no_points(spark):
    x = np.concatenate([np.zeros((900, 3)), np.eye(3) * 50])
    assign, summ = B.cluster_micro(frame(spark, x), 0.5)
    assert sorted((r.label, r.n) for r in summ.collect()) == [(0, 900), (900, 1), (901, 1), (902, 1)]
    assign, summ = B.cluster_micro(frame(spark, x).limit(0), 0.5)
    assert assign.count() == summ.count() == 0
