"""Citation graph (JN6-JN8, AGG11): edges, reverse lookup, bounded expansion.

The working form is the edge table (cited_link, citing_link); per-link arrays
are only built for export.  Expansion is ``depth`` unrolled equi-joins on a
distinct (seed, node) frontier - no recursion on the driver, no collect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def citation_edges(news: DataFrame, link_col: str = "link", refs_col: str = "refers_to") -> DataFrame:
    """(cited_link, citing_link): one row per distinct reference of an article."""
    return news.select(F.explode(F.array_distinct(F.col(refs_col))).alias("cited_link"),
                       F.col(link_col).alias("citing_link"))


def citations(news: DataFrame, link_col: str = "link", refs_col: str = "refers_to") -> DataFrame:
    """JN6: for every corpus link, the articles whose references contain it.

    Returns edges restricted to cited links present in the corpus, plus one
    row with a NULL citing link for corpus links nobody cites (left join)."""
    edges = citation_edges(news, link_col, refs_col)
    links = news.select(F.col(link_col).alias("cited_link")).distinct()
    return links.join(edges, "cited_link", "left")


def suits(edges: DataFrame) -> DataFrame:
    """AGG11: sorted citing links per link ([] when none) - export form."""
    return edges.groupBy(F.col("cited_link").alias("link")).agg(
        F.array_sort(F.collect_list("citing_link")).alias("suits"))


def suits_of(links: DataFrame, suits_df: DataFrame, link_col: str = "link") -> DataFrame:
    """JN7: citing links of each given link, [] when unknown."""
    s = suits_df.select(F.col("link").alias("_l"), "suits")
    return (links.join(s, F.col(link_col) == F.col("_l"), "left").drop("_l")
            .withColumn("suits", F.coalesce("suits", F.array().cast("array<string>"))))


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 3, seed_col: str = "link") -> DataFrame:
    """JN8: (seed, node) for every node reachable in 1..depth citation hops
    (node cites the previous one), cycles allowed, the seed itself removed.

    Each hop is an equi-join of the distinct frontier with the edge table;
    the frontier is checkpointed so lineage stays one hop long."""
    e = edges.filter(F.col("citing_link").isNotNull()).select(
        F.col("cited_link").alias("node"), F.col("citing_link").alias("next"))
    frontier = seeds.select(F.col(seed_col).alias("seed"), F.col(seed_col).alias("node")).distinct()
    reached = None
    for _ in range(depth):
        frontier = (frontier.join(e, "node").select("seed", F.col("next").alias("node")).distinct())
        frontier = cut_lineage(frontier)
        reached = frontier if reached is None else reached.unionByName(frontier)
    return reached.distinct().filter(F.col("node") != F.col("seed"))
