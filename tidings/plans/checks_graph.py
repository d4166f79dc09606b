"""Checked plans for the citation graph (JN6-JN8, AGG11, SRC7, SRC15, Q7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import relational as R
from ..sources import io as IO
from . import fixtures as X
from .registry import register

NEWS = X.with_ctes(X.SQL_NEWS_LIKE)
EDGES = """, edges AS (SELECT DISTINCT unnest(refers_to) AS cited_link, link AS citing_link
               FROM (SELECT link, list_distinct(refers_to) AS refers_to FROM news_like)),
cit AS (SELECT n.link AS cited_link, e.citing_link FROM (SELECT DISTINCT link FROM news_like) n
        LEFT JOIN edges e ON e.cited_link = n.link),
suits AS (SELECT cited_link AS link, coalesce(list_sort(list(citing_link) FILTER (WHERE citing_link IS NOT NULL)), [])
                 AS suits FROM cit GROUP BY cited_link)
"""


@register("jn6_citations", NEWS + EDGES + """
SELECT cited_link, citing_link FROM cit""")
def jn6(spark, sf):
    return G.citations(X.news_like(spark, sf)).select("cited_link", "citing_link")


@register("agg11_suits", NEWS + EDGES + """
SELECT link, array_to_string(suits, ',') AS suits, CAST(len(suits) AS INTEGER) AS n FROM suits""")
def agg11(spark, sf):
    s = G.suits(G.citations(X.news_like(spark, sf)))
    return s.select("link", F.array_join("suits", ",").alias("suits"), F.size("suits").alias("n"))


@register("jn7_suits_of", NEWS + EDGES + f"""
SELECT w.link, array_to_string(coalesce(s.suits, []), ',') AS suits
FROM (SELECT link FROM news_like WHERE "timestamp" BETWEEN TIMESTAMP '{X.AT}' - INTERVAL {X.DIGEST_DAYS} DAY
      AND TIMESTAMP '{X.AT}') w LEFT JOIN suits s ON s.link = w.link""")
def jn7(spark, sf):
    news = X.news_like(spark, sf)
    w = R.time_window(news, X.AT, X.DIGEST_DAYS).select("link")
    s = G.suits_of(w, G.suits(G.citations(news)))
    return s.select("link", F.array_join("suits", ",").alias("suits"))


@register("jn8_expand", "WITH RECURSIVE " + X.SQL_NEWS_LIKE.strip() + EDGES + f""",
seeds AS (SELECT link FROM news_like WHERE "timestamp" BETWEEN TIMESTAMP '{X.AT}' - INTERVAL {X.DIGEST_DAYS} DAY
          AND TIMESTAMP '{X.AT}'),
r(seed, node, depth) AS (
  SELECT link, link, 0 FROM seeds
  UNION
  SELECT r.seed, e.citing_link, r.depth + 1 FROM r JOIN edges e ON e.cited_link = r.node WHERE r.depth < 3)
SELECT DISTINCT seed, node FROM r WHERE depth >= 1 AND node <> seed""")
def jn8(spark, sf):
    news = X.news_like(spark, sf)
    seeds = R.time_window(news, X.AT, X.DIGEST_DAYS).select("link")
    return G.expand(G.citations(news), seeds, 3).select("seed", "node")


@register("src15_write_citations", NEWS + EDGES + """
SELECT link, array_to_string(suits, ',') AS suits FROM suits""")
def src15(spark, sf):
    s = G.suits(G.citations(X.news_like(spark, sf)))
    back = IO.write_citations(s, spark)
    return back.select("link", F.array_join("suits", ",").alias("suits"))


@register("src7_read_citations", NEWS + EDGES + """
SELECT cited_link, citing_link FROM cit""")
def src7(spark, sf):
    s = G.suits(G.citations(X.news_like(spark, sf)))
    path = IO.write_citations(s, spark, return_path=True)
    return IO.read_citations(spark, path).select("cited_link", "citing_link")


@register("q7_build_citations", NEWS + EDGES + """
SELECT n.id, n.link, CAST(len(s.suits) AS INTEGER) AS n_suits FROM news_like n JOIN suits s ON s.link = n.link""")
def q7(spark, sf):
    news = X.news_like(spark, sf)
    s = G.suits(G.citations(news))
    return news.join(s, "link").select("id", "link", F.size("suits").alias("n_suits"))
