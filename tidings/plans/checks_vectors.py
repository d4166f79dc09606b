"""Checked plans for vector functions, kNN joins, tagging and centroids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import knn as K
from ..operators import relational as R
from ..operators import sparse as SP
from . import fixtures as X
from .registry import register

VEC = X.with_ctes(X.SQL_VECTORS)
DIST = X.sql_dist("q.vec", "d.vec")
# thresholds for the 64-d driver vectors (minimum pair cosine distance 0.487)
SQ_NEAR = 1.3          # squared L2, ~ cosine distance 0.65
COS_T = 0.65           # cosine distance


def _partner_sql() -> str:
    return "(SELECT count(*) FROM embeddings)"


@register("fn6_l2_normalize", VEC + """
SELECT id, round(CAST(vec[1] AS DOUBLE) / sqrt(s), 6) AS x1, round(CAST(vec[64] AS DOUBLE) / sqrt(s), 6) AS x64
FROM (SELECT id, vec, """ + X.sql_dot("vec", "vec") + """ AS s FROM vectors)""")
def fn6(spark, sf):
    v = X.vectors(spark, sf).withColumn("u", S.l2_normalize("vec", as_float=False))
    return v.select("id", F.round(F.col("u")[0], 6).alias("x1"), F.round(F.col("u")[63], 6).alias("x64"))


def _partners(spark, sf):
    v = X.vectors(spark, sf)
    n = v.select(F.count(F.lit(1))).scalar()
    p = v.select(F.col("id").alias("pid"), F.col("vec").alias("pvec"))
    return v.withColumn("pid", (F.col("id") * 7 + 1) % n).join(p, "pid")


_PARTNER_SQL = VEC + """, pairs AS (
  SELECT q.id, d.id AS pid, q.vec AS qv, d.vec AS dv FROM vectors q
  JOIN vectors d ON d.id = (q.id * 7 + 1) % (SELECT count(*) FROM vectors))
"""


@register("fn7_sq_l2", _PARTNER_SQL + f"""
SELECT id, pid, round({X.sql_dist('qv', 'dv')}, 6) AS sq_l2, round({X.sql_dot('qv', 'dv')}, 6) AS ip FROM pairs""")
def fn7(spark, sf):
    j = _partners(spark, sf)
    return j.select("id", "pid", F.round(S.sq_l2("vec", "pvec"), 6).alias("sq_l2"),
                    F.round(S.dot("vec", "pvec"), 6).alias("ip"))


@register("fn8_cosine", _PARTNER_SQL + f"""
SELECT id, pid, round({X.sql_dot('qv', 'dv')} / sqrt({X.sql_dot('qv', 'qv')}) / sqrt({X.sql_dot('dv', 'dv')}), 6) AS cos
FROM pairs""")
def fn8(spark, sf):
    j = _partners(spark, sf)
    return j.select("id", "pid", F.round(S.cosine_similarity("vec", "pvec"), 6).alias("cos"))


_KNN_SQL = VEC + f""", pairs AS (
  SELECT q.id, d.id AS nid, {DIST} AS dist FROM vectors q, vectors d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS rank FROM pairs)
"""


@register("jn9_knn_exact", _KNN_SQL + """
SELECT id, nid, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM ranked WHERE rank <= 5""")
def jn9(spark, sf):
    v = X.vectors(spark, sf)
    nn = K.knn_exact(v, v, 5)
    return nn.select("id", "nid", "rank", F.round("dist", 6).alias("dist"))


@register("flt7_near", _KNN_SQL + f"""
SELECT id, nid, round(dist, 6) AS dist FROM ranked WHERE rank <= 100 AND id <> nid AND dist < {SQ_NEAR}""")
def flt7(spark, sf):
    v = X.vectors(spark, sf)
    nn = K.near_rows(v, v, 100, SQ_NEAR).where("id <> nid")
    return nn.select("id", "nid", F.round("dist", 6).alias("dist"))


@register("vec5_similar_news", _KNN_SQL + f"""
SELECT id, string_agg(CAST(nid AS VARCHAR), ',' ORDER BY dist, nid) AS similar
FROM ranked WHERE rank <= 100 AND id <> nid AND dist < {SQ_NEAR} GROUP BY id""")
def vec5(spark, sf):
    v = X.vectors(spark, sf)
    nn = K.near_rows(v, v, 100, SQ_NEAR).where("id <> nid")
    lst = nn.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dist", "nid"))).alias("l"))
    return lst.select("id", F.array_join(F.transform("l", lambda x: x["nid"].cast("string")), ",").alias("similar"))


@register("rnk6_topk_per_key", VEC + f""", pairs AS (
  SELECT q.id, d.id AS nid, 1 - {X.sql_dot('q.vec', 'd.vec')} / sqrt({X.sql_dot('q.vec', 'q.vec')})
         / sqrt({X.sql_dot('d.vec', 'd.vec')}) AS dist
  FROM vectors q, vectors d WHERE q.id <> d.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS rank FROM pairs WHERE dist < {COS_T})
SELECT id, nid, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3""")
def rnk6(spark, sf):
    p = K.similar_pairs(X.vectors(spark, sf), COS_T)
    both = p.select(F.col("a").alias("id"), F.col("b").alias("nid"), "dist").unionByName(
        p.select(F.col("b").alias("id"), F.col("a").alias("nid"), "dist"))
    return R.topk_per_key(both, 3).select("id", "nid", "rank")


@register("vec4_lookup_one", VEC + f""", q AS (SELECT * FROM vectors WHERE id = (SELECT max(id) FROM vectors)),
pairs AS (SELECT d.id AS nid, {X.sql_dist('q.vec', 'd.vec')} AS dist FROM q, vectors d),
ranked AS (SELECT *, row_number() OVER (ORDER BY dist, nid) AS rank FROM pairs)
SELECT nid, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM ranked WHERE rank <= 10""")
def vec4(spark, sf):
    v = X.vectors(spark, sf)
    vector = v.orderBy(F.desc("id")).first()["vec"]
    nn = K.lookup_one(vector, v, 10)
    return nn.select("nid", "rank", F.round("dist", 6).alias("dist"))


_TAG_SQL = X.with_ctes(X.SQL_VECTORS, X.SQL_TAXONOMY) + f""", pairs AS (
  SELECT q.id, t.code_id, t.code, {X.sql_dist('q.vec', 't.vec')} AS dist
  FROM vectors q, taxonomy_like t),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, code_id) AS rank FROM pairs),
kept AS (SELECT * FROM ranked WHERE rank <= 100 AND (rank = 1 OR dist <= {SQ_NEAR}))
"""


def _tag_pairs(spark, sf):
    arts = X.vectors(spark, sf)
    tax = X.taxonomy_like(spark, sf)
    nn = K.threshold_or_best_rows(arts, tax.select(F.col("code_id").alias("id"), "vec"), 100, SQ_NEAR)
    return nn.join(tax.select(F.col("code_id").alias("nid"), "code"), "nid")


@register("flt8_threshold_or_best", _TAG_SQL + """
SELECT id, code_id, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM kept""")
def flt8(spark, sf):
    return _tag_pairs(spark, sf).select("id", F.col("nid").alias("code_id"), "rank",
                                        F.round("dist", 6).alias("dist"))


@register("vec6_tag_articles", _TAG_SQL + """
SELECT id, array_to_string(list_sort(list_distinct(list(split_part(code, '.', 1) || '.' || split_part(code, '.', 2)))), ',') AS okveds
FROM kept GROUP BY id""")
def vec6(spark, sf):
    pairs = _tag_pairs(spark, sf)
    cs = R.code_set(pairs.select(F.col("id").alias("news_id"), F.col("code").alias("okved")))
    return cs.select(F.col("news_id").alias("id"), F.array_join("okveds", ",").alias("okveds"))


@register("agg4_centroids", VEC + """, el AS (
  SELECT label, unnest(range(1, 65)) AS pos, unnest(vec) AS x FROM vectors),
c AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM el GROUP BY label, pos)
SELECT label, round(max(CASE WHEN pos = 1 THEN m END), 6) AS c1, round(max(CASE WHEN pos = 64 THEN m END), 6) AS c64,
       round(sqrt(sum(m * m)), 6) AS norm
FROM c GROUP BY label""")
def agg4(spark, sf):
    c = K.centroids(X.vectors(spark, sf), "label", "vec", None)
    return c.select("label", F.round(F.col("centroid")[0], 6).alias("c1"),
                    F.round(F.col("centroid")[63], 6).alias("c64"),
                    F.round(S.l2_norm("centroid"), 6).alias("norm"))


@register("rnk8_central", VEC + """, el AS (
  SELECT label, unnest(range(1, 65)) AS pos, unnest(vec) AS x FROM vectors),
c AS (SELECT label, list(m ORDER BY pos) AS cen FROM
      (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM el GROUP BY label, pos) GROUP BY label),
d AS (SELECT c.label, v.id, """ + X.sql_dist("c.cen", "v.vec") + """ AS dist FROM c, vectors v)
SELECT label, arg_min(id, (dist, id)) AS id FROM d GROUP BY label""")
def rnk8(spark, sf):
    v = X.vectors(spark, sf)
    c = K.centroids(v, "label", "vec", None)
    return K.central(v, c, "label", "id", "vec").select(F.col("label").cast("int"), "id")


@register("jn14_similar_pairs", VEC + f""", pairs AS (
  SELECT q.id AS a, d.id AS b, 1 - {X.sql_dot('q.vec', 'd.vec')} / sqrt({X.sql_dot('q.vec', 'q.vec')})
         / sqrt({X.sql_dot('d.vec', 'd.vec')}) AS dist
  FROM vectors q, vectors d WHERE q.id < d.id)
SELECT a, b, round(dist, 6) AS dist FROM pairs WHERE dist < {COS_T}""")
def jn14(spark, sf):
    p = K.similar_pairs(X.vectors(spark, sf), COS_T)
    return p.select("a", "b", F.round("dist", 6).alias("dist"))


@register("vec3_ivf_fit")
def vec3(spark, sf):
    v = X.vectors(spark, sf)
    cells, centers, nlist, nprobe = K.build_index(v)
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@register("jn10_knn_ivf")
def jn10(spark, sf):
    v = X.vectors(spark, sf)
    cells, centers, nlist, nprobe = K.build_index(v)
    nn = K.knn_ivf(v, cells, centers, 5, K.search_probes(nlist))
    return nn.select("id", "nid", "rank", F.round("dist", 6).alias("dist"))


def _vec_items(spark, sf):
    v = X.vectors(spark, sf)
    ts = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
          + F.make_dt_interval(days=(F.col("id") % 90).cast("int"), hours=(F.col("id") % 24).cast("int")))
    return v.withColumn("timestamp", ts)


@register("rnk5_importance", VEC + f""", items AS (
  SELECT id, vec, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(id % 90 AS INTEGER)) + to_hours(CAST(id % 24 AS BIGINT)) AS ts
  FROM vectors),
pairs AS (
  SELECT q.id AS a, d.id AS b FROM items q, items d
  WHERE q.id <> d.id AND 1 - {X.sql_dot('q.vec', 'd.vec')} / sqrt({X.sql_dot('q.vec', 'q.vec')})
        / sqrt({X.sql_dot('d.vec', 'd.vec')}) < {COS_T}
    AND abs(epoch_us(q.ts) - epoch_us(d.ts)) <= 3 * 86400000000)
SELECT i.id, CAST(count(p.b) AS BIGINT) AS importance FROM items i LEFT JOIN pairs p ON p.a = i.id GROUP BY i.id""")
def rnk5(spark, sf):
    items = _vec_items(spark, sf)
    pairs, member = K.similar_classes(items.select("id", "vec"), COS_T)
    return R.importance(pairs, items, 3, member=member)


# bags of words over the titles: inverted-index joins ---------------------------------
TITLE_T = 0.3          # cosine distance between title bags
TITLE_SQ = 0.6         # squared L2 of the same

_BAGS_SQL = X.with_ctes(X.SQL_NEWS_LIKE) + f""", tok AS (
  SELECT id, unnest({X.sql_tokens('title')}) AS term FROM news_like),
cnt AS (SELECT id, term, count(*) AS n FROM tok GROUP BY id, term),
bag AS (SELECT id, term, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM cnt)
"""


def _title_bags(spark, sf):
    return SP.bag_vectors(X.news_like(spark, sf), "title")


@register("vec1_bag_vectors", _BAGS_SQL + "SELECT id, term, round(w, 6) AS weight FROM bag")
def vec1_bags(spark, sf):
    return _title_bags(spark, sf).select("id", "term", F.round("weight", 6).alias("weight"))


@register("vec2_sentence_bags", X.with_ctes(X.SQL_NEWS_LIKE) + f""", tok AS (
  SELECT id, unnest({X.sql_tokens("concat_ws(chr(10), title, text)")}) AS term FROM news_like),
cnt AS (SELECT id, term, count(*) AS n FROM tok GROUP BY id, term)
SELECT id, term, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS weight FROM cnt""")
def vec2_bags(spark, sf):
    news = X.news_like(spark, sf).withColumn("flat", F.concat_ws("\n", "title", "text"))
    return SP.bag_vectors(news, "flat").select("id", "term", F.round("weight", 6).alias("weight"))


_TITLE_DOTS_SQL = _BAGS_SQL + """, dots AS (
  SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS dot FROM bag x JOIN bag y ON x.term = y.term GROUP BY x.id, y.id)
"""


@register("jn14_similar_titles", _TITLE_DOTS_SQL + f"""
SELECT a, b, {X.sql_r6('greatest(0.0, 1 - dot)')} AS dist FROM dots WHERE a < b AND 1 - dot < {TITLE_T}""")
def jn14_titles(spark, sf):
    return SP.similar_pairs(_title_bags(spark, sf), TITLE_T).select("a", "b", X.r6(F.col("dist")).alias("dist"))


@register("flt7_near_titles", _TITLE_DOTS_SQL + f""", ranked AS (
  SELECT a AS id, b AS nid, greatest(0.0, 2 - 2 * dot) AS dist,
         row_number() OVER (PARTITION BY a ORDER BY round(greatest(0.0, 2 - 2 * dot), 9), b) AS rank
  FROM dots WHERE 2 - 2 * dot < {TITLE_SQ})
SELECT id, nid, CAST(rank AS INTEGER) AS rank, {X.sql_r6('dist')} AS dist FROM ranked WHERE rank <= 5""")
def flt7_titles(spark, sf):
    b = _title_bags(spark, sf)
    return SP.near_rows(b, b, 5, TITLE_SQ).select("id", "nid", "rank", X.r6(F.col("dist")).alias("dist"))


@register("rnk8_central_titles", _BAGS_SQL + """, lab AS (SELECT id, id % 7 AS label FROM news_like),
mean AS (SELECT label, term, sum(w) / max(c.n) AS w FROM bag JOIN lab USING (id)
         JOIN (SELECT label, count(*) AS n FROM lab GROUP BY label) c USING (label) GROUP BY label, term),
dots AS (SELECT m.label, b.id, sum(m.w * b.w) AS dot FROM mean m JOIN bag b USING (term) GROUP BY m.label, b.id),
d AS (SELECT label, id, 1 - 2 * dot AS s FROM dots
      UNION ALL SELECT l.label, n.id, 0 FROM (SELECT DISTINCT label FROM lab) l, news_like n
      WHERE n.id NOT IN (SELECT id FROM bag))
SELECT label, arg_min(id, (round(s, 9), id)) AS id FROM d GROUP BY label""")
def rnk8_titles(spark, sf):
    b = _title_bags(spark, sf)
    labels = X.news_like(spark, sf).select("id", (F.col("id") % 7).alias("label"))
    return SP.central(b, labels).select("label", "id")
