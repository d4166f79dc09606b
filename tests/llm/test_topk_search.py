import numpy as np
import pytest

from tidings.llm import topk_search as T


def brute(rows, k, step=100):
    ints = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, asked = [], {}
    for i, v in ints:
        if i is not None and i % step == 0 and (i not in asked or v < asked[i]):
            asked[i] = v
    for i, v in asked.items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for j, w in ints if j != i)
        out += [(i, r + 1, j, -x) for r, (x, _, _, j) in enumerate(s[:k])]
    return sorted(out, key=str)


def check(spark, rows, k=10, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, T.search(df, k, **options).collect()), key=str)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute(rows, k)


@pytest.mark.parametrize("options", [{}, {"block_rows": 40, "query_rows": 2}, {"levels": (1, 2, 3, 5)}])
def test_equals_brute_force(spark, options):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 12))
    rows = [(i, [float(x) for x in centres[i % 5] + 0.1 * rng.normal(size=12)]) for i in range(420)]
    rows += [(500 + i, rows[0][1]) for i in range(60)]  # a hot vector, ties
    check(spark, rows, **options)


def test_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, []), (200, None), (300, [None, 1.0]), (400, [float("nan"), 1.0]),
            (500, [float("inf"), 0.0]), (1, [3.0]), (1, [3.0]), (None, [9.0, 9.0]), (None, [3.0]), (2, [-1.0, 5.0, 7.0]),
            (0, [0.5, 2.0]), (None, None)]
    check(spark, rows)
    check(spark, rows, k=2, block_rows=2, query_rows=1)
    check(spark, [(0, [1.0])])


def test_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-10 ** 5, 10 ** 5, 6)]) for i in range(0, 400, 10)]
    check(spark, rows)


def test_empty(spark):
    check(spark, [])


def test_bounds_hold():
    rng = np.random.default_rng(3)
    q, x = rng.integers(-500, 500, (30, 13)).astype(float), rng.integers(-500, 500, (40, 13)).astype(float)
    last = None
    for n in (1, 2, 4, 13, 50):
        b = T._bounds(T.segment_table(q, n), T.segment_table(x, n))
        assert (b >= q @ x.T).all()
        if n in (1, 2, 4) and last is not None:
            assert (b <= last + 1e-6 * np.abs(last) + 1).mean() > 0.9
        last = b
