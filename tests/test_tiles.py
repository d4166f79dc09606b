"""Tiles of cells: vectors are shuffled a fixed number of times, results leave a
group in batches; loops of joins whose size estimates do not grow."""

import numpy as np
import pyarrow as pa
import pytest

from tidings.operators import cluster as C
from tidings.operators import knn as K

DIMS = 8


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")


@pytest.mark.parametrize("search", ["knn", "range", "near"])
def test_a_row_is_sent_to_a_bounded_number_of_groups(spark, monkeypatch, search):
    """1,500 rows without structure in 75 cells: a row went to every cell, in two
    parts, and met 75 parts there; now it goes to 13 tiles or their parts at most."""
    x = np.random.default_rng(6).normal(size=(1500, DIMS))
    v, sent, cut = frame(spark, x), [], K.sub_blocks

    def watched(*args):
        sides = cut(*args)
        sent.extend(side.count() for side in sides)
        return sides
    monkeypatch.setattr(K, "sub_blocks", watched)
    monkeypatch.setattr(K, "SMALL_ROWS", 3)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    if search == "knn":
        got = {(r.id, r.nid) for r in K.knn_exact(v, v, 4, block_rows=20).collect()}
        want = {(i, int(j)) for i in range(1500) for j in np.argsort(d[i], kind="stable")[:4]}
    elif search == "range":
        got = {(r.id, r.nid) for r in K.range_pairs(v, v, 5.0, 20, triangle=True).collect()}
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(d < 5.0)) if i < j}
    else:
        got = {(r.id, r.nid) for r in K.near_rows(v, v, 3, 5.0, 20).collect()}
        want = {(i, int(j)) for i in range(1500) for j in np.argsort(d[i], kind="stable")[:3] if d[i, j] < 5.0}
    assert got == want
    assert len(sent) == 2 and max(sent) <= 26 * 1500


def test_probed_cells_are_one_list_a_tile(spark, monkeypatch):
    """A query is sent to the tiles of its cells, not to every cell, and meets the rows of its cells alone."""
    x = np.random.default_rng(7).normal(size=(900, DIMS))
    v, sent, cut = frame(spark, x), [], K.sub_blocks

    def watched(*args):
        sides = cut(*args)
        sent.append(sides[1].count())
        return sides
    centers = spark.createDataFrame([(i, [float(t) for t in x[i * 15]]) for i in range(60)], "cell long, vec array<double>")
    home = ((x[:, None, :] - x[None, ::15, :]) ** 2).sum(-1)
    cells = spark.createDataFrame([(i, [float(t) for t in r], int(home[i].argmin())) for i, r in enumerate(x)],
                                  "id long, vec array<double>, cell long")
    monkeypatch.setattr(K, "sub_blocks", watched)
    got = {(r.id, r.nid, r.rank) for r in K.knn_ivf(v, cells, centers, 3, 36).collect()}
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    probed = np.argsort(home, axis=1, kind="stable")[:, :36]
    d[~(home.argmin(axis=1)[None, :, None] == probed[:, None, :]).any(-1)] = np.inf
    assert got == {(i, int(j), n + 1) for i in range(900) for n, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    assert sent[-1] <= 900 * K.TILES


@pytest.mark.parametrize("k", [None, 5])
def test_pairs_leave_a_group_in_batches(k):
    """Every pair of a group is below the cut: none are held together, and the
    k nearest, ties by id, do not keep all ties."""
    n = 3000
    x = np.zeros((n, DIMS))
    side = lambda here: pa.table({"here": pa.array([here] * n), "cell": pa.array(np.zeros(n, np.int64)), "id": pa.array(np.arange(n)),
                                  "vec": pa.array(list(x)), "into": pa.nulls(n, pa.list_(pa.int64()))})
    batches = pa.concat_tables([side(True), side(False)]).to_batches()
    out = list(K._tile_kernel(None, None, 0, k, 1.0, False, False)(iter(batches)))
    assert max(map(len, out)) <= K.CHUNK_VALUES
    assert sum(map(len, out)) == n * (k or n)
    if k:
        assert set(pa.Table.from_batches(out)["nid"].to_pylist()) == set(range(k))


def test_estimates_do_not_grow_with_the_rounds(spark):
    """A checkpoint keeps the estimate of its size, the product of a join's sides:
    its digits doubled every round (11,165 bits after eight)."""
    n = 600
    edges = spark.createDataFrame([(i * 79 % n, (i + 1) * 79 % n) for i in range(n - 1)], "a long, b long")
    found = C.connected_components(spark.range(n), edges)
    assert {r.label for r in found.collect()} == {0}
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200
