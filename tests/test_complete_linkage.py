"""Complete linkage: components that end in one task, and rounds of joins."""

import random

import pytest

from tidings.operators import cluster as C


def run(spark, ids, edges):
    v = spark.createDataFrame([(i,) for i in ids], "id long")
    e = spark.createDataFrame(edges, "a long, b long, d double")
    return {r.id: r.label for r in C.cluster_complete(v, edges=e).collect()}


def brute(ids, edges):
    """Rounds of mutual nearest clusters by (d, a, b), as the docstring defines them."""
    label, e = {i: i for i in ids}, {(a, b): d for a, b, d in edges}
    while e:
        best = {}
        for (a, b), d in e.items():
            for c in (a, b):
                best[c] = min(best.get(c, (d, a, b)), (d, a, b))
        to = {b: a for _, a, b in best.values() if best[a] == best[b] == (e[a, b], a, b)}
        label = {i: to.get(x, x) for i, x in label.items()}
        seen = {}
        for (a, b), d in e.items():
            x, y = sorted((to.get(a, a), to.get(b, b)))
            if x != y:
                seen.setdefault((x, y), []).append(d)
        size = {c: 2 for c in to.values()}
        e = {p: max(ds) for p, ds in seen.items() if len(ds) == size.get(p[0], 1) * size.get(p[1], 1)}
    return label


@pytest.mark.parametrize("local", [12, 1 << 20])
def test_rounds_equal_brute_force(spark, monkeypatch, local):
    """Ties included; with some components that end in one task, with all."""
    monkeypatch.setattr(C, "LOCAL_EDGES", local)
    rng = random.Random(5)
    edges = {}
    for base in (0, 100, 200):
        for _ in range(9 if base else 28):
            a, b = sorted(rng.sample(range(base, base + 10), 2))
            edges[a, b] = rng.randint(1, 6) / 10
    edges = [(a, b, d) for (a, b), d in edges.items()]
    ids = [*range(10), *range(100, 110), *range(200, 210), 999]
    assert run(spark, ids, edges) == brute(ids, edges)


def test_long_chain_takes_few_jobs(spark, monkeypatch):
    """A chain in which one pair at a time is nearest to each other: 20 rounds,
    which were 40 checkpoints before."""
    made, cut = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: made.append(1) or cut(df))
    edges = [(i, i + 1, 1.0 - i / 100) for i in range(40)]
    assert run(spark, range(41), edges) == brute(range(41), edges)
    assert len(made) < 15
