"""Helpers shared by the pipeline operators: staged tables, joins that survive
hot keys, row selection and connected components."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.session import read_table, scratch_path

LONG_MIN = -(2 ** 63)
#: A key is hot when it holds more than one row in this many; there are at
#: most this many hot keys, whatever the data, so they can be broadcast.
HOT_KEYS = 1000


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder below the shared checkpoint folder and
    read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_per_key(rows: DataFrame, stats: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``stats``, which has one row per ``key`` and
    in ``count`` the key's number of rows; ``total`` is the number of rows.

    Keys with more than ``total / HOT_KEYS`` rows are at most ``HOT_KEYS`` and
    are broadcast, so their rows are never shuffled; the others are shuffled,
    and none of them is heavy.
    """
    is_hot = F.col(count) * F.lit(HOT_KEYS) > F.lit(total)
    hot, cold = stats.where(is_hot), stats.where(~is_hot)
    to_hot = rows.join(F.broadcast(hot), key)
    to_cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return to_hot.unionByName(to_cold)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_key: Column) -> DataFrame:
    """The rows of ``docs`` named by ``kept`` (columns ``id``, ``key``,
    ``same``): null ids are ``LONG_MIN``, ``key`` is the value of ``text_key``
    and ``same`` the number of rows of ``docs`` with both; of several such
    rows one stays.  The join is on id and text, so copies spread."""
    cols, (i, k) = docs.columns, fresh_names(docs, "_id", "_key")
    tagged = docs.withColumns({i: F.coalesce(F.col(id_col).cast("long"), F.lit(LONG_MIN)), k: text_key})
    named = kept.select(F.col("id").alias(i), F.col("key").alias(k), "same")
    single = tagged.join(named.where("same = 1").select(i, k), [i, k], "left_semi")
    several = tagged.join(named.where("same > 1").select(i, k), [i, k], "left_semi")
    return single.select(*cols).unionByName(several.dropDuplicates([i, k]).select(*cols))


def _edge_digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of undirected ``edges`` (long ``a``, ``b``):
    ``(node, root)`` with the smallest node as root, for nodes with an edge.

    Alternates the large-star and small-star steps of Kiveris et al. (2014);
    every round is a join and aggregations over the edges, written to the
    shared folder, and no list of neighbours is ever built.  A hub's edges are
    not brought together (``join_per_key``).
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                           F.least("a", "b").alias("b")).distinct(), name)
    seen = _edge_digest(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = 2 * seen[0]  # an edge's end has at most this many; a hub's edges stay where they are
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
        large = join_per_key(both, low, "a", "n", ends).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_per_key(large, low, "a", "n", ends).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b")
        e = stage(small.select(F.greatest("a", "b").alias("a"),
                               F.least("a", "b").alias("b")).distinct(), name)
        now = _edge_digest(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
