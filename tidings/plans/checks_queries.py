"""Checked end-to-end queries (Q1-Q9).

``*_given`` variants replace the vector clustering / similarity search by
groups derived from the data (exact-title groups), so that the whole
composition has an SQL oracle; the plain variants run the full composition
(title vectors, complete-linkage clustering, kNN) and are checked by rows
and by invariants in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as CL
from ..functions.wordlists import TOPIC_NAMES
from ..operators import graph as G
from ..operators import knn as K
from ..operators import relational as R
from ..operators import text as T
from ..session import read_table, scratch_path, stage_table
from ..sources import io as IO
from . import fixtures as X
from . import queries as Q
from .registry import register

AT_SQL = f"TIMESTAMP '{X.AT}'"
TS = X.sql_ts('"timestamp"')
USER = X._sql_list(X.USER_CODES)


def given_labels(news, days=None):
    """(id, group, is_central_news): exact-title groups, label = min id,
    central = latest article of the group."""
    g = news.groupBy("title").agg(F.min("id").alias("group"), F.max("timestamp").alias("_mx"))
    lab = news.join(g, "title")
    return lab.select("id", "group", (F.col("timestamp") == F.col("_mx")).alias("is_central_news"))


def _win_labels(spark, sf, days):
    news = X.news_like(spark, sf)
    win = Q.select_window(news, X.roles_table(spark), X.AT, X.ROLE, days)
    return news, given_labels(win)


def _digest_sql(days: int, personal: bool = False) -> str:
    ctes = [X.SQL_NEWS_LIKE, X.SQL_ROLES, X.SQL_ROLE_SOURCES]
    if personal:
        ctes += [X.SQL_NEWS_CODES, X.SQL_RELATED]
    sql = X.with_ctes(*ctes) + f""",
win AS (SELECT * FROM news_like WHERE "timestamp" BETWEEN {AT_SQL} - INTERVAL {days} DAY AND {AT_SQL}
        AND source IN (SELECT source FROM role_sources WHERE role = '{X.ROLE}')),
lab0 AS (SELECT *, min(id) OVER (PARTITION BY title) AS "group",
                "timestamp" = max("timestamp") OVER (PARTITION BY title) AS is_central_news FROM win)"""
    if personal:
        sql += f""",
eff AS (SELECT DISTINCT okved FROM (
  SELECT unnest({USER}) AS okved
  UNION ALL SELECT r.related FROM related_codes r WHERE list_contains({USER}, r.okved)
  UNION ALL SELECT unnest(add_okveds) FROM roles WHERE role = '{X.ROLE}')),
matched AS (SELECT DISTINCT news_id FROM news_codes
            WHERE okved IN (SELECT okved FROM eff) OR split_part(okved, '.', 1) IN (SELECT okved FROM eff)),
rate AS (SELECT "group", avg(CASE WHEN id IN (SELECT news_id FROM matched) THEN 1.0 ELSE 0.0 END) AS r
         FROM lab0 GROUP BY "group"),
lab AS (SELECT * FROM lab0 WHERE "group" IN (SELECT "group" FROM rate WHERE r >= 0.5))"""
    else:
        sql += ",\nlab AS (SELECT * FROM lab0)"
    sql += f""",
st AS (SELECT "group", count(*) AS size,
              (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6 / 86400.0 AS span FROM lab GROUP BY "group"),
top AS (SELECT * FROM st ORDER BY size DESC, span DESC, "group" DESC LIMIT 3),
rep AS (SELECT "group", min(id) AS id FROM lab WHERE is_central_news GROUP BY "group")
SELECT l.id, l.title, l.link, l.source, {X.sql_ts('l."timestamp"')} AS ts, t."group", t.size,
       round(t.span, 6) AS span_days
FROM top t JOIN rep r ON r."group" = t."group" JOIN lab l ON l.id = r.id"""
    return sql


def _digest_out(df):
    return df.select("id", "title", "link", "source", X.ts_str(F.col("timestamp")).alias("ts"), "group", "size",
                     F.round("span_days", 6).alias("span_days"))


@register("q1_digest_given", _digest_sql(X.DIGEST_DAYS))
def q1g(spark, sf):
    news, labels = _win_labels(spark, sf, X.DIGEST_DAYS)
    return _digest_out(Q.digest(spark, news, X.roles_table(spark), X.AT, X.ROLE, "all", None,
                                days=X.DIGEST_DAYS, labels=labels))


@register("q1_digest_given_personal", _digest_sql(X.DIGEST_DAYS, personal=True))
def q1gp(spark, sf):
    news, labels = _win_labels(spark, sf, X.DIGEST_DAYS)
    return _digest_out(Q.digest(spark, news, X.roles_table(spark), X.AT, X.ROLE, "my_and_contractor_okveds",
                                X.USER_CODES, days=X.DIGEST_DAYS, labels=labels,
                                news_codes=X.news_codes_like(spark, sf), related=X.related_codes_like(spark, sf)))


@register("q2_trends_given", _digest_sql(X.TRENDS_DAYS))
def q2g(spark, sf):
    news, labels = _win_labels(spark, sf, X.TRENDS_DAYS)
    return _digest_out(Q.trends_query(spark, news, X.roles_table(spark), X.AT, X.ROLE, "all", None, labels=labels))


@register("q1_digest")
def q1(spark, sf):
    news = X.news_like(spark, sf)
    return _digest_out(Q.digest(spark, news, X.roles_table(spark), X.AT, X.ROLE, "all", None, days=X.DIGEST_DAYS))


@register("q2_trends")
def q2(spark, sf):
    news = X.news_like(spark, sf)
    return _digest_out(Q.trends_query(spark, news, X.roles_table(spark), X.AT, X.ROLE, "my_okveds", X.USER_CODES,
                                      news_codes=X.news_codes_like(spark, sf)))


# ---- Q3 insights ------------------------------------------------------------------
def given_near(news):
    """(id, nid): each article's nearest 'similar' article = the smallest id
    with the same title (linear: one pair per article, no all-pairs)."""
    g = news.groupBy("title").agg(F.min("id").alias("nid"))
    return news.join(g, "title").filter(F.col("id") != F.col("nid")).select("id", "nid")


def given_topics(news):
    names = F.array(*[F.lit(x) for x in TOPIC_NAMES])
    return news.select("id", F.element_at(names, (F.col("id") % len(TOPIC_NAMES) + 1).cast("int")).alias("topic"))


_TOPICS_SQL = X._sql_list(TOPIC_NAMES)
_EDGES_SQL = """edges AS (SELECT DISTINCT unnest(list_distinct(refers_to)) AS cited_link, link AS citing_link FROM news_like)"""


def _insights_sql(final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in [X.SQL_NEWS_LIKE, X.SQL_ROLES, X.SQL_ROLE_SOURCES]) + f""",
{_EDGES_SQL},
win AS (SELECT * FROM news_like WHERE "timestamp" BETWEEN {AT_SQL} - INTERVAL {X.DIGEST_DAYS} DAY AND {AT_SQL}
        AND source IN (SELECT source FROM role_sources WHERE role = '{X.ROLE}')),
lab AS (SELECT *, min(id) OVER (PARTITION BY title) AS "group" FROM win),
st AS (SELECT "group", count(*) AS size,
              (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) AS span FROM lab GROUP BY "group"),
top AS (SELECT * FROM st ORDER BY size DESC, span DESC, "group" DESC LIMIT 3),
members AS (SELECT id FROM lab WHERE "group" IN (SELECT "group" FROM top)),
gmin AS (SELECT title, min(id) AS nid FROM news_like GROUP BY title),
near AS (SELECT n.id, g.nid FROM news_like n JOIN gmin g ON g.title = n.title
         WHERE n.id <> g.nid AND n.id IN (SELECT id FROM members)),
seeds AS (SELECT DISTINCT n.link FROM near JOIN news_like n ON n.id = near.nid),
r(seed, node, depth) AS (
  SELECT link, link, 0 FROM seeds
  UNION
  SELECT r.seed, e.citing_link, r.depth + 1 FROM r JOIN edges e ON e.cited_link = r.node WHERE r.depth < 3),
reached AS (SELECT DISTINCT node AS link FROM r WHERE depth >= 1 AND node <> seed),
pool_ids AS (SELECT DISTINCT max(n.id) AS id FROM reached JOIN news_like n ON n.link = reached.link GROUP BY reached.link),
pool AS (SELECT * FROM news_like WHERE id IN (SELECT id FROM pool_ids)
         AND "timestamp" <= {AT_SQL} - INTERVAL {X.HORIZON_DAYS} DAY),
scored AS (SELECT id, title, {_TOPICS_SQL}[id % 10 + 1] AS topic FROM pool),
best AS (SELECT topic, arg_max(title, id) AS title FROM scored GROUP BY topic),
names AS (SELECT CAST(i - 1 AS INTEGER) AS topic_pos, {_TOPICS_SQL}[i] AS topic FROM range(1, 11) t(i)),
spine AS (SELECT n.topic_pos, n.topic, coalesce(b.title, '-') AS title FROM names n LEFT JOIN best b ON b.topic = n.topic)
{final}"""


def _insights_given(spark, sf):
    news = X.news_like(spark, sf)
    edges = G.citation_edges(news)
    return Q.insights(spark, news, X.roles_table(spark), edges, given_topics(news), X.AT, X.ROLE,
                      near=given_near(news), labels=_win_labels(spark, sf, X.DIGEST_DAYS)[1])


@register("q3_insights_given", _insights_sql("SELECT topic_pos, topic, title FROM spine"))
def q3g(spark, sf):
    return _insights_given(spark, sf)[0]


@register("q3_insights_report_given", _insights_sql("""
SELECT coalesce(string_agg('**' || topic || ':**' || chr(10) || title || chr(10) || chr(10), '' ORDER BY topic_pos)
       FILTER (WHERE title <> '-'), '') AS report FROM spine"""))
def q3rg(spark, sf):
    return _insights_given(spark, sf)[1]


@register("q3_insights")
def q3(spark, sf):
    news = X.news_like(spark, sf)
    vecs = stage_table(T.vectorize(news, "title", "id"), "title-vectors")
    td = X.token_docs_like(spark, sf)
    phrases, wv, cvm, lda = Q.build_topics(td, 20, 10, 3, 0.5, 32, 5, 42)
    spine, report = Q.insights(spark, news, X.roles_table(spark), G.citation_edges(news), None,
                               X.AT, X.ROLE, topic_model=(phrases, wv, 32, cvm, lda), importance_t=0.35,
                               vectors=vecs, max_sq=0.35)
    return spine


# ---- Q4-Q9 ---------------------------------------------------------------------------
def _landing_from_pages(spark, sf, root):
    """Raw crawler records from ``pages``: one JSON Lines folder and one
    wrapped-list file per host."""
    from ..functions import extract as E
    p = read_table(spark, sf, "pages")
    raw = p.select(F.col("url").alias("link"), E.inner("html", "article").alias("text"),
                   E.inner("html", "h1").alias("title"), E.host_of("url").alias("source"),
                   CL.to_iso(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                             + F.make_dt_interval(days=(F.col("page_id") % 50).cast("int"))).alias("timestamp"),
                   E.extract_links("html").alias("refers_to"))
    half = raw.filter(F.col("link").contains("/en/") | F.col("link").contains("/fr/"))
    rest = raw.join(half.select("link"), "link", "left_anti")
    half.write.mode("overwrite").json(f"{root}/lines")
    (X.wrapped_lists(rest).withColumn("file", F.hex(F.xxhash64("value"))).write.mode("overwrite")
     .partitionBy("source", "day", "file").text(f"{root}/wrapped"))
    return root


def _q4_sql() -> str:
    from .checks_extract import HOST_SQL, HREF, sql_html_text, sql_inner, sql_space
    return f"""
WITH raw AS (
  SELECT url AS link, nfc_normalize({sql_space(sql_html_text(sql_inner('html', 'article')))}) AS text,
         nfc_normalize({sql_space(sql_inner('html', 'h1'))}) AS title, {HOST_SQL} AS source,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(page_id % 50 AS INTEGER)) AS t,
         CAST(len(regexp_extract_all(html, '{HREF}', 1)) AS INTEGER) AS n_refs
  FROM pages)
SELECT CAST(row_number() OVER (ORDER BY link, t, title, source, text) - 1 AS BIGINT) AS id, link, title,
       strftime(t, '%Y-%m-%d %H:%M:%S') AS ts, n_refs, CAST(length(text) AS INTEGER) AS n_chars FROM raw"""


@register("q4_build_corpus", _q4_sql())
def q4(spark, sf):
    root = _landing_from_pages(spark, sf, scratch_path(spark, "crawl"))
    c = Q.build_corpus(spark, root, lines_glob="*.json", whole_glob="*.txt")
    return c.select("id", "link", "title", X.ts_str(F.col("timestamp")).alias("ts"),
                    F.size("refers_to").alias("n_refs"), F.length("text").alias("n_chars"))


@register("q5_build_tags", X.with_ctes(X.SQL_VECTORS, X.SQL_TAXONOMY) + f""", pairs AS (
  SELECT q.id, t.code_id, t.code, {X.sql_dist('q.vec', 't.vec')} AS dist
  FROM vectors q, taxonomy_like t),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, code_id) AS rank FROM pairs),
kept AS (SELECT * FROM ranked WHERE rank <= 100 AND (rank = 1 OR dist <= 1.3))
SELECT id AS news_id, unnest(list_distinct(list(split_part(code, '.', 1) || '.' || split_part(code, '.', 2)))) AS okved
FROM kept GROUP BY id""")
def q5(spark, sf):
    arts = X.vectors(spark, sf).select("id", "vec")
    tags = Q.build_tags(arts, X.taxonomy_like(spark, sf), 100, 1.3)
    path = IO.write_code_map(tags, scratch_path(spark, "tags"))
    return IO.read_code_map(spark, path)


@register("q6_build_index")
def q6(spark, sf):
    vecs, _, _ = Q.build_index(X.vectors(spark, sf).select("id", "vec"), scratch_path(spark, "index"), 64)
    return vecs.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


_Q9_SQL = X.with_ctes(X.SQL_VECTORS) + f""",
q AS (SELECT * FROM vectors ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id LIMIT 10),
pairs AS (SELECT q.id, d.id AS nid, {X.sql_dist('q.vec', 'd.vec')} AS dist FROM q, vectors d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS rank FROM pairs)
SELECT id, string_agg(CAST(nid AS VARCHAR), ',' ORDER BY dist, nid) AS similar
FROM ranked WHERE rank <= 100 AND id <> nid AND dist < 1.3 GROUP BY id"""


def _id_list(sims):
    return sims.select("id", F.array_join(F.transform("similar", lambda x: x.cast("string")), ",").alias("similar"))


@register("q9_demo_similar", _Q9_SQL)
def q9(spark, sf):
    return _id_list(Q.demo_similar(X.vectors(spark, sf).select("id", "vec"), 10, 100, 1.3))


@register("q9_demo_stored", _Q9_SQL)
def q9_stored(spark, sf):
    v = X.vectors(spark, sf).select("id", "vec")
    path = scratch_path(spark, "index")
    Q.build_index(v, path, 64)
    return _id_list(Q.demo_similar(v, 10, 100, 1.3, index=path))


@register("vec5_similar_stored", X.with_ctes(X.SQL_VECTORS) + f""",
pairs AS (SELECT q.id, d.id AS nid, {X.sql_dist('q.vec', 'd.vec')} AS dist FROM vectors q, vectors d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS rank FROM pairs)
SELECT id, nid, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM ranked
WHERE rank <= 100 AND id <> nid AND dist < 1.3""")
def vec5_stored(spark, sf):
    v = X.vectors(spark, sf).select("id", "vec")
    path = scratch_path(spark, "index")
    Q.build_index(v, path, 64)
    return Q.similar_stored(spark, path, v, 100, 1.3).select("id", "nid", "rank", F.round("dist", 6).alias("dist"))
