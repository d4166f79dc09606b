"""Cells with bounds: exact kNN and range joins against brute force, and how
many cells they pass over; the stored index and its dynamic pruning."""

import contextlib
import io

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidings.operators import knn as K

DIMS = 8


def clustered(n=600, centres=12, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, DIMS)) * 10
    return c[rng.integers(0, centres, n)] + rng.normal(scale=0.3, size=(n, DIMS))


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")


def sq(x, y):
    return ((x[:, None, :] - y[None, :, :]) ** 2).sum(-1)


@pytest.mark.parametrize("clustered_data", [True, False])
def test_knn_by_cells_equals_brute_force(spark, clustered_data):
    rng = np.random.default_rng(2)
    x = clustered() if clustered_data else rng.normal(size=(600, DIMS))
    q = x[:50] + rng.normal(scale=0.1, size=(50, DIMS))
    got = {}
    for r in K.knn_exact(frame(spark, q), frame(spark, x), 7, block_rows=40).collect():
        got.setdefault(r.id, {})[r.rank] = r.nid
    d = sq(q, x)
    for i in range(len(q)):
        assert [got[i][k] for k in range(1, 8)] == np.lexsort((np.arange(len(x)), d[i]))[:7].tolist()


@pytest.mark.parametrize("radius", [0.4, 1.0, 4.0])
def test_range_join_by_cells_equals_brute_force(spark, radius):
    x = clustered(400)
    v = frame(spark, x)
    d = sq(x, x)
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if d[i, j] < radius}
    got = [(r.id, r.nid) for r in K.range_pairs(v, v, radius, block_rows=30, triangle=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    both = [(r.id, r.nid) for r in K.range_pairs(v, frame(spark, x[:100]), radius, block_rows=30).collect()]
    assert len(both) == len(set(both)) and set(both) == {(i, j) for i in range(400) for j in range(100) if d[i, j] < radius}


def test_cells_are_passed_over(spark):
    """On clustered vectors most (row, cell) pairs are ruled out, on rows
    without structure none need be."""
    x = clustered(2000, 40)
    v = frame(spark, x)
    cells, _ = K.fit_cells(v, 50, 5)
    assert cells.reach(x, k=5).mean() < 0.15
    assert cells.reach(x, radius=1.0).mean() < 0.15
    copies = K.to_cells(v, cells, radius=1.0, triangle=True).count()
    assert copies < 4 * len(x)


def test_bounds_never_lose_a_neighbour(spark):
    rng = np.random.default_rng(4)
    for x in (clustered(300, 5), rng.normal(size=(300, DIMS)), np.repeat(rng.normal(size=(10, DIMS)), 30, axis=0)):
        cells, homes = K.fit_cells(frame(spark, x), 17, 4)
        home = {r.id: r.cell for r in homes.collect()}
        d = sq(x, x)
        by_k, by_radius = cells.reach(x, k=4), cells.reach(x, radius=1.2)
        for i in range(len(x)):
            for j in np.argsort(d[i])[:4]:
                assert by_k[i, home[j]] or (d[i] < d[i, j]).sum() + (d[i] == d[i, j]).sum() > 4
            for j in np.flatnonzero(d[i] < 1.44):
                assert by_radius[i, home[j]]


def test_a_small_side_is_taken_along(spark):
    x = clustered(300)
    v, q = frame(spark, x), frame(spark, x[:20])
    few = K.near_rows(q, v, 5, 0.8)
    assert "Exchange hashpartitioning(cell" not in few._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted((r.id, r.nid, r.rank) for r in df.collect())
    limit = K.SMALL_ROWS
    K.SMALL_ROWS = 3
    try:
        assert key(K.near_rows(q, v, 5, 0.8, block_rows=30)) == key(few)
        many = key(K.near_rows(v, q, 5, 0.8, block_rows=30))
    finally:
        K.SMALL_ROWS = limit
    assert many == key(K.near_rows(v, q, 5, 0.8))


def test_stored_index_is_pruned_while_the_query_runs(spark, tmp_path):
    from tidings.plans import queries as Q
    x = clustered(900, 30)
    v = frame(spark, x).withColumn("vec", F.col("vec").cast("array<float>"))
    path = str(tmp_path / "index")
    store, centers, _ = Q.build_index(v, path, DIMS)
    asked = v.where("id < 15")
    found = Q.similar_stored(spark, path, asked, 20, 0.9)
    key = lambda df: sorted((r.id, r.nid, r.rank) for r in df.collect())
    assert key(found) == key(K.near_rows(asked, v, 20, 0.9).where("id <> nid"))
    asked_cells = spark.createDataFrame([(int(store.first()["cell"]),)], "cell long")
    pruned = K.probed_rows(store, asked_cells)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        pruned.explain("formatted")
    assert "dynamicpruning" in text.getvalue().lower()
    assert len({r.cell for r in pruned.collect()}) == 1 < store.select("cell").distinct().count()


class _Rows:
    """Stands for a frame: keeps the function that runs on its batches."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *_):
        return self

    def mapInPandas(self, fn, schema):
        return fn


def test_copies_and_distances_leave_in_small_batches(spark):
    """A batch of rows times its cells (or times the small side) is never held:
    with every row in every cell that was all copies of a batch at once."""
    rng = np.random.default_rng(3)
    x, piv = rng.normal(size=(3000, DIMS)), rng.normal(size=(400, DIMS))
    cells = K.Cells(piv, np.zeros(400), np.full(400, 99.0), np.full(400, 10), np.full((400, 1), np.inf))
    pdf = pd.DataFrame({"id": np.arange(3000), "vec": list(x)})
    rows = _Rows(frame(spark, x[:1]).schema)
    parts = list(K.to_cells(rows, cells, radius=50.0)(iter([pdf])))
    assert sum(map(len, parts)) == 3000 * 400
    assert max(map(len, parts)) * DIMS <= K.CHUNK_VALUES
    few = pdf.iloc[:1500]
    most, kernel = [], K._pair_kernel(2, None, False)

    def watched(*_):
        def run(key, left, right):
            most.append(len(left) * len(right))
            return kernel(key, left, right)
        return run
    with pytest.MonkeyPatch.context() as m:
        m.setattr(K, "_pair_kernel", watched)
        found = pd.concat(K._in_place(rows, few, 2, None, False)(iter([pdf])))
    assert len(found) == 6000 and max(most) <= K.CHUNK_VALUES


def test_vectors_are_shuffled_once_on_their_way_to_a_block(spark):
    """The cells' sizes come to the rows; the rows are not shuffled by cell first."""
    v = frame(spark, clustered(200))
    lo, hi = K.sub_blocks(v.withColumn("cell", F.col("id") % 5), v.withColumn("cell", F.col("id") % 5), "cell", 20)
    for side in (lo, hi):
        txt = side._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in txt and "Exchange hashpartitioning" not in txt
    assert lo.count() == 200 * 4 and hi.count() == 200 * 4
