"""Exact top-k search by inner product with multi-resolution segment statistics.

Components become integers.  A vector is cut into segments, and a table holds
each segment's mean and deviation at several resolutions.  Over one segment of
n components <x, y> is at most n (mean mean' + dev dev'), so the sum over the
segments bounds the score (equally: bounds the distance from below, as
|x - y|^2 = |x|^2 + |y|^2 - 2 <x, y>), and a finer cut gives a tighter bound.
Per block of rows, a query's coarse bounds pick the rows to score first; the
k-th best of those, and of all rows of the first block, which is searched before
the others, is its threshold; only rows whose bound reaches it go on to the next resolution, and only survivors of the finest
are scored exactly.

Rows are dealt by a hash to blocks of about ``BLOCK_ROWS`` and the
queries to blocks of ``QUERY_ROWS``; every query block meets every row block
in a task of its own and sends its k best on, so a task holds one block of
each and a hot vector or label is no hot group.  The k best of all blocks are taken by
rank per query.

Defined cases: vectors that are null or hold a null or a non-finite component
take no part; shorter vectors count as filled up with zeros, an empty one
scores 0; rows that share the query's id are its own and no candidates; of
rows with a query's id repeated, the smallest vector asks; rows with a null id
are candidates whose ties come last; scores need |score| < 2^63; an empty
table gives no rows; other columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.llm.common import stage
from tidings.session import read_table

SCALE = 1024
QUERY_STEP = 100
TOP = 10
BLOCK_ROWS = 16_384
QUERY_ROWS = 512
#: Segments of each resolution, coarse to fine.
LEVELS = (4, 16)


def quantise(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as long; null when the vector
    takes no part."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    usable = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return F.when(usable, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def segment_table(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """sqrt(size) times mean and deviation of ``n`` segments of every row."""
    cuts = np.linspace(0, x.shape[1], min(n, x.shape[1]) + 1).astype(int)[:-1]
    size = np.diff(np.append(cuts, x.shape[1]))
    mean = np.add.reduceat(x, cuts, axis=1) / size
    square = np.add.reduceat(x * x, cuts, axis=1) / size
    dev = np.sqrt(np.maximum(square - mean * mean, 0))
    return mean * np.sqrt(size), dev * np.sqrt(size)


def _bounds(qt, xt) -> np.ndarray:
    b = qt[0] @ xt[0].T + qt[1] @ xt[1].T
    return b + 1e-9 * (np.abs(b) + 1)  # above rounding


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of row pairs; in doubles where these are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2 ** 53:
        return np.einsum("ij,ij->i", q.astype(float), x.astype(float)).astype(np.int64)
    return np.einsum("ij,ij->i", q, x)


def block_top(q_id, q, x_id, x, k: int, levels=LEVELS, known_floor=None):
    """(query row, id, score) of each query's ``k`` best rows of one block;
    ``x`` is in rising order of id, nulls last.  Rows below ``known_floor``, the
    query's k-th best score in the first block, are left out."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (q, x))
    qf, xf = q.astype(float), x.astype(float)
    alive = np.ones((len(q), len(x)), bool)
    if width:
        tables = [(segment_table(qf, n), segment_table(xf, n)) for n in levels]
        coarse = _bounds(*tables[0])
    else:
        tables, coarse = [], np.zeros(alive.shape)
    alive &= ~(x_id[0][None, :] & (x_id[1][None, :] == q_id[:, None]))  # a query's own row
    # threshold: the k-th best exact score among the rows of the best coarse bounds
    few = min(len(x), 2 * k)
    first = np.argpartition(np.where(alive, -coarse, np.inf), few - 1, axis=1)[:, :few]
    rows = np.repeat(np.arange(len(q)), few)
    score = _exact(q[rows], x[first.ravel()]).reshape(len(q), few)
    score = np.where(np.take_along_axis(alive, first, axis=1), score, np.iinfo(np.int64).min)
    at = np.sort(score, axis=1)[:, -min(k, few)]
    floor = np.where(at == np.iinfo(np.int64).min, -np.inf, at.astype(float)) if few >= k else np.full(len(q), -np.inf)
    if known_floor is not None:
        floor = np.maximum(floor, known_floor)
    floor = floor - 1e-9 * np.abs(np.where(np.isfinite(floor), floor, 0))
    alive &= coarse >= floor[:, None]
    for qt, xt in tables[1:]:
        alive &= _bounds(qt, xt) >= floor[:, None]
    out = []
    for i in range(len(q)):  # survivors of one query at a time
        on = np.flatnonzero(alive[i])
        s = _exact(np.broadcast_to(q[i], (len(on), width)), x[on])
        best = np.lexsort((on, -s))[:k]  # ties: smaller position, that is id
        out.append((np.full(len(best), i), on[best], s[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _vectors(column) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _compare(k: int, levels):
    def run(key, left, right):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                          "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        right = right.sort_by([("vec_id", "ascending")])
        ids = right["vec_id"].combine_chunks()
        known = np.asarray(ids.is_valid())
        numbers = np.asarray(ids.fill_null(0))
        q_id = left["vec_id"].to_numpy()
        x = _vectors(right["v"])
        q = _vectors(left["v"])
        floor = left["floor"].to_numpy() if "floor" in left.column_names else None
        i, j, s = block_top(q_id, q, (known, numbers), x, k, levels, floor)
        return pa.table({"query_id": pa.array(q_id[i], pa.int64()), "vec_id": ids.take(pa.array(j)),
                         "score": pa.array(s, pa.int64())})
    return run


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def top_k(queries: DataFrame, rows: DataFrame, k: int = TOP, levels: tuple = LEVELS,
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``; both inputs have
    ``vec_id`` and the integer vector ``v``."""
    n_rows, n_queries = rows.count(), queries.count()
    m, p = max(1, -(-n_rows // block_rows)), max(1, -(-n_queries // query_rows))
    dealt = rows.withColumn("xb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(m)))
    # columns of their own: queries are mostly some of the rows
    q = queries.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"))
    q = q.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(p)))
    schema = "query_id long, vec_id long, score long"

    def compare(asked: DataFrame, asked_rows: DataFrame) -> DataFrame:
        x = asked_rows.withColumn("qb", F.explode(_numbers(p)))
        return asked.groupBy("qb", "xb").cogroup(x.groupBy("qb", "xb")).applyInArrow(_compare(k, levels), schema)

    # the first block gives every query a floor that goes with it to the others
    found = compare(q.withColumn("xb", F.lit(0).cast("long")), dealt.where("xb = 0"))
    if m > 1:
        found = stage(found, "first-block")
        floors = found.groupBy(F.col("query_id").alias("vec_id")).agg(
            F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor"))
        q = q.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        others = q.withColumn("xb", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(m - 1).cast("long"))))
        found = found.unionByName(compare(others, dealt.where("xb > 0")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def search(vectors: DataFrame, k: int = TOP, step: int = QUERY_STEP, id_col: str = "vec_id",
           vector_col: str = "embedding", **options) -> DataFrame:
    """Queries: the rows whose id is divisible by ``step``; candidates: all
    rows but the query's own."""
    rows = stage(vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantise(F.col(vector_col)).alias("v"))
                 .where("v is not null"), "vectors")
    queries = rows.where(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return top_k(queries, rows, k, **options)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
