"""Checked plans for clustering (CLU1-CLU5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as C
from . import fixtures as X
from .registry import register

EPS = 0.65   # cosine distance for the 64-d driver vectors


@register("clu2_cluster_dbscan", """
WITH RECURSIVE vectors AS (SELECT vec_id AS id, embedding AS vec FROM embeddings),
pairs AS (
  SELECT q.id AS a, d.id AS b FROM vectors q, vectors d
  WHERE q.id < d.id AND 1 - """ + X.sql_dot("q.vec", "d.vec") + " / sqrt(" + X.sql_dot("q.vec", "q.vec")
     + ") / sqrt(" + X.sql_dot("d.vec", "d.vec") + f""") <= {EPS}),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b AS a, a AS b FROM pairs),
deg AS (SELECT a AS id, count(*) AS d FROM edges GROUP BY a),
core AS (SELECT id FROM deg WHERE d + 1 >= 2),
cedges AS (SELECT a, b FROM edges WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
cc(id, lab) AS (SELECT id, id FROM core UNION SELECT e.b, cc.lab FROM cc JOIN cedges e ON e.a = cc.id),
core_lab AS (SELECT id, min(lab) AS lab FROM cc GROUP BY id),
border AS (SELECT e.a AS id, min(cl.lab) AS lab FROM edges e JOIN core_lab cl ON cl.id = e.b
           WHERE e.a NOT IN (SELECT id FROM core) GROUP BY e.a)
SELECT v.id, CAST(coalesce(cl.lab, bl.lab, -1) AS BIGINT) AS label
FROM vectors v LEFT JOIN core_lab cl ON cl.id = v.id LEFT JOIN border bl ON bl.id = v.id""")
def clu2(spark, sf):
    return C.cluster_dbscan(X.vectors(spark, sf), EPS, 2)


@register("clu1_cluster_complete")
def clu1(spark, sf):
    return C.cluster_complete(X.vectors(spark, sf), EPS)


@register("clu3_cluster_micro")
def clu3(spark, sf):
    assign, summ = C.cluster_micro(X.vectors(spark, sf), 0.5)
    return summ.select("label", "n", F.round("radius", 6).alias("radius"))


@register("clu4_group_news")
def clu4(spark, sf):
    v = X.vectors(spark, sf)
    news = v.select("id", "label")
    g = C.group_news(news, v, 2, EPS)
    return g.select("id", "group", "is_central_news")


@register("clu5_personalised_trends")
def clu5(spark, sf):
    v = X.vectors(spark, sf)
    g = C.group_news(v.select("id"), v, 1, EPS)
    return C.personalised_trends(g, X.news_codes_like(spark, sf), X.USER_CODES, 0.5).select("id", "group")
