"""Checked plans for filters, joins, aggregations, ranking, sets and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from . import fixtures as X
from .registry import register
from ..session import read_table

AT_SQL = f"TIMESTAMP '{X.AT}'"
NEWS = X.with_ctes(X.SQL_NEWS_LIKE)
NEWS_ROLES = X.with_ctes(X.SQL_NEWS_LIKE, X.SQL_ROLES, X.SQL_ROLE_SOURCES)
CODES = X.with_ctes(X.SQL_NEWS_CODES)
CODES_REL = X.with_ctes(X.SQL_NEWS_CODES, X.SQL_RELATED, X.SQL_ROLES)
USER_SQL = X._sql_list(X.USER_CODES)


def _win_sql(days: int) -> str:
    return (f'"timestamp" BETWEEN {AT_SQL} - INTERVAL {days} DAY AND {AT_SQL}')


# ---- 2.4 filters --------------------------------------------------------------
@register("flt1_time_window", NEWS + f"""
SELECT id, {X.sql_ts('"timestamp"')} AS ts FROM news_like WHERE {_win_sql(X.DIGEST_DAYS)}""")
def flt1(spark, sf):
    n = R.time_window(X.news_like(spark, sf), X.AT, X.DIGEST_DAYS)
    return n.select("id", X.ts_str(F.col("timestamp")).alias("ts"))


@register("flt2_for_role", NEWS_ROLES + f"""
SELECT id, source FROM news_like
WHERE source IN (SELECT source FROM role_sources WHERE role = '{X.ROLE}')""")
def flt2(spark, sf):
    n = R.for_role(X.news_like(spark, sf), X.role_sources(spark), X.ROLE)
    return n.select("id", "source")


@register("flt3_before_horizon", NEWS + f"""
SELECT id FROM news_like WHERE "timestamp" <= {AT_SQL} - INTERVAL {X.HORIZON_DAYS} DAY""")
def flt3(spark, sf):
    return R.before_horizon(X.news_like(spark, sf), X.AT, X.HORIZON_DAYS).select("id")


@register("flt4_in_pool", X.with_ctes(X.SQL_NEWS_LIKE, X.SQL_NEWS_CODES) + """
SELECT id, title FROM news_like
WHERE id IN (SELECT news_id FROM news_codes WHERE okved LIKE '03.%')""")
def flt4(spark, sf):
    pool = X.news_codes_like(spark, sf).filter(F.col("okved").startswith("03."))
    return R.in_pool(X.news_like(spark, sf), pool, "id", "news_id").select("id", "title")


@register("flt5_codes_match", CODES + f"""
SELECT news_id, bool_or(list_contains({USER_SQL}, okved)
                        OR list_contains({USER_SQL}, split_part(okved, '.', 1))) AS matched
FROM news_codes GROUP BY news_id""")
def flt5(spark, sf):
    per = X.news_codes_like(spark, sf).groupBy("news_id").agg(F.collect_list("okved").alias("okveds"))
    user = F.array(*[F.lit(c) for c in X.USER_CODES])
    return per.select("news_id", R.codes_match("okveds", user).alias("matched"))


@register("flt6_min_group_size", NEWS + """
SELECT id, title FROM news_like
WHERE title IN (SELECT title FROM news_like GROUP BY title HAVING count(*) >= 2)""")
def flt6(spark, sf):
    return R.min_group_size(X.news_like(spark, sf), "title", 2).select("id", "title")


@register("flt9_sample_n", X.with_ctes(X.SQL_NEWS_LIKE) + """
SELECT id, title FROM news_like ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id LIMIT 10""")
def flt9(spark, sf):
    return R.sample_n(X.news_like(spark, sf), 10).select("id", "title")


@register("flt10_split", X.with_ctes(X.SQL_NEWS_LIKE) + """
SELECT id FROM news_like
WHERE CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '|42'), 1, 7) AS BIGINT) % 10000 < 2000""")
def flt10(spark, sf):
    train, test = R.split(X.news_like(spark, sf), 0.2)
    return test.select("id")


# ---- 2.5 joins ------------------------------------------------------------------
@register("jn1_attach_codes", X.with_ctes(X.SQL_NEWS_LIKE, X.SQL_NEWS_CODES) + """
SELECT n.id, n.source, c.okved FROM news_like n JOIN news_codes c ON n.id = c.news_id""")
def jn1(spark, sf):
    return R.attach_codes(X.news_like(spark, sf), X.news_codes_like(spark, sf)).select("id", "source", "okved")


@register("jn2_link_to_id", NEWS + """
SELECT r.link, max(n.id) AS id
FROM (SELECT DISTINCT unnest(refers_to) AS link FROM news_like) r
JOIN news_like n ON n.link = r.link GROUP BY r.link""")
def jn2(spark, sf):
    news = X.news_like(spark, sf)
    links = news.select(F.explode("refers_to").alias("link")).distinct()
    return R.link_to_id(news, links).select("link", "id")


@register("jn3_id_to_link", NEWS + f"""
SELECT w.id, n.link FROM (SELECT id FROM news_like WHERE {_win_sql(X.DIGEST_DAYS)}) w
JOIN news_like n ON n.id = w.id""")
def jn3(spark, sf):
    news = X.news_like(spark, sf)
    ids = R.time_window(news, X.AT, X.DIGEST_DAYS).select("id")
    return R.id_to_link(ids, news).select("id", "link")


@register("jn4_expand_related", CODES_REL + f"""
SELECT DISTINCT okved FROM (
  SELECT unnest({USER_SQL}) AS okved
  UNION ALL
  SELECT r.related FROM related_codes r WHERE list_contains({USER_SQL}, r.okved))""")
def jn4(spark, sf):
    user = spark.createDataFrame([(c,) for c in X.USER_CODES], "okved string")
    return R.effective_codes(user, X.related_codes_like(spark, sf)).select("okved")


@register("jn5_add_role_codes", X.with_ctes(X.SQL_NEWS_CODES, X.SQL_ROLES_OF_DOCS) + """
SELECT DISTINCT okved FROM (
  SELECT split_part(okved, '.', 1) || '.' || split_part(okved, '.', 2) AS okved FROM news_codes
  UNION ALL
  SELECT unnest(add_okveds) FROM doc_roles WHERE role = 'role5')""")
def jn5(spark, sf):
    role_codes = X.roles_of_docs(spark, sf).filter(F.col("role") == "role5").select(
        F.explode("add_okveds").alias("okved"))
    return R.effective_codes(X.news_codes_like(spark, sf).select("okved"), None, role_codes).select("okved")


@register("set1_effective_codes", CODES_REL + f"""
SELECT DISTINCT okved FROM (
  SELECT unnest({USER_SQL}) AS okved
  UNION ALL
  SELECT r.related FROM related_codes r WHERE list_contains({USER_SQL}, r.okved)
  UNION ALL
  SELECT unnest(add_okveds) FROM roles WHERE role = '{X.ROLE}')""")
def set1(spark, sf):
    user = spark.createDataFrame([(c,) for c in X.USER_CODES], "okved string")
    role_codes = X.roles_table(spark).filter(F.col("role") == X.ROLE).select(
        F.explode("add_okveds").alias("okved"))
    return R.effective_codes(user, X.related_codes_like(spark, sf), role_codes).select("okved")


# ---- 2.6 aggregations -------------------------------------------------------------
GIVEN = f"""
win AS (SELECT * FROM news_like WHERE {_win_sql(X.TRENDS_DAYS)}),
lab AS (SELECT *, min(id) OVER (PARTITION BY title) AS "group" FROM win)"""


def _given_labels(spark, sf, days=X.TRENDS_DAYS):
    """Exact-title groups in the window; label = min id of the group."""
    win = R.time_window(X.news_like(spark, sf), X.AT, days)
    labels = win.groupBy("title").agg(F.min("id").alias("group"))
    return win.join(labels, "title")


@register("agg1_cluster_stats", NEWS.rstrip() + "," + GIVEN + """
SELECT "group", count(*) AS size,
       round((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6 / 86400.0, 6) AS span_days
FROM lab GROUP BY "group" """)
def agg1(spark, sf):
    st = R.cluster_stats(_given_labels(spark, sf))
    return st.select("group", "size", F.round("span_days", 6).alias("span_days"))


@register("agg2_rank_metrics", NEWS.rstrip() + "," + GIVEN + """
SELECT "group", CAST(floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6 / 86400) AS BIGINT) AS days,
       count(*) AS size,
       round(CAST(floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6 / 86400) AS DOUBLE) / count(*), 6) AS square
FROM lab GROUP BY "group" """)
def agg2(spark, sf):
    m = R.rank_metrics(_given_labels(spark, sf))
    return m.select("group", "days", "size", F.round("square", 6).alias("square"))


@register("agg3_match_rate", X.with_ctes(X.SQL_NEWS_LIKE, X.SQL_NEWS_CODES).rstrip() + "," + GIVEN + f""",
flags AS (
  SELECT l."group", l.id, coalesce(bool_or(list_contains({USER_SQL}, c.okved)
                              OR list_contains({USER_SQL}, split_part(c.okved, '.', 1))), false) AS m
  FROM lab l LEFT JOIN news_codes c ON c.news_id = l.id GROUP BY l."group", l.id)
SELECT "group", round(avg(CAST(m AS DOUBLE)), 6) AS match_rate FROM flags GROUP BY "group"
HAVING avg(CAST(m AS DOUBLE)) >= 0.5""")
def agg3(spark, sf):
    lab = _given_labels(spark, sf)
    codes = X.news_codes_like(spark, sf).groupBy("news_id").agg(F.collect_list("okved").alias("okveds"))
    user = F.array(*[F.lit(c) for c in X.USER_CODES])
    flags = (lab.join(codes, lab["id"] == codes["news_id"], "left")
             .select("group", R.codes_match(F.coalesce("okveds", F.array().cast("array<string>")), user).alias("m")))
    return R.match_rate(flags, "group", "m", 0.5).select("group", F.round("match_rate", 6).alias("match_rate"))


@register("agg5_code_set", CODES + """
SELECT news_id, array_to_string(list_sort(list_distinct(list(split_part(okved, '.', 1) || '.' || split_part(okved, '.', 2)))), ',') AS okveds
FROM news_codes GROUP BY news_id""")
def agg5(spark, sf):
    cs = R.code_set(X.news_codes_like(spark, sf))
    return cs.select("news_id", F.array_join("okveds", ",").alias("okveds"))


@register("agg6_slice_counts", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS slice, count(*) AS n FROM orders GROUP BY 1""")
def agg6(spark, sf):
    o = read_table(spark, sf, "orders")
    return R.slice_counts(o, S.year_slice("o_orderdate"))


@register("agg7_time_extent", NEWS + f"""
SELECT {X.sql_ts('min("timestamp")')} AS min_ts, {X.sql_ts('max("timestamp")')} AS max_ts FROM news_like""")
def agg7(spark, sf):
    te = R.time_extent(X.news_like(spark, sf))
    return te.select(X.ts_str(F.col("min_ts")).alias("min_ts"), X.ts_str(F.col("max_ts")).alias("max_ts"))


# ---- 2.7 ranking ---------------------------------------------------------------------
@register("rnk1_top_clusters", NEWS.rstrip() + "," + GIVEN + """
SELECT "group", count(*) AS size,
       round((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6 / 86400.0, 6) AS span_days
FROM lab GROUP BY "group"
ORDER BY size DESC, (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) DESC, "group" DESC LIMIT 3""")
def rnk1(spark, sf):
    top = R.top_clusters(R.cluster_stats(_given_labels(spark, sf)), 3)
    return top.select("group", "size", F.round("span_days", 6).alias("span_days"))


def _rnk2_sql(metric: str) -> str:
    m = ("CAST(floor((epoch_us(max(\"timestamp\")) - epoch_us(min(\"timestamp\"))) / 1e6 / 86400) AS DOUBLE) / count(*)"
         if metric == "square" else "count(*)")
    return NEWS.rstrip() + "," + GIVEN + f"""
SELECT "group", count(*) AS size FROM lab GROUP BY "group" ORDER BY {m} DESC, "group" ASC LIMIT 3"""


@register("rnk2_rank_newsgroups_square", _rnk2_sql("square"))
def rnk2s(spark, sf):
    return R.rank_newsgroups(R.rank_metrics(_given_labels(spark, sf)), "square", 3).select("group", "size")


@register("rnk2_rank_newsgroups_power", _rnk2_sql("power"))
def rnk2p(spark, sf):
    return R.rank_newsgroups(R.rank_metrics(_given_labels(spark, sf)), "power", 3).select("group", "size")


@register("rnk3_representative", NEWS.rstrip() + "," + GIVEN + """,
cen AS (SELECT *, "timestamp" = max("timestamp") OVER (PARTITION BY "group") AS is_central_news FROM lab)
SELECT "group", min(id) AS id FROM cen WHERE is_central_news GROUP BY "group" """)
def rnk3(spark, sf):
    lab = _given_labels(spark, sf)
    latest = lab.groupBy("group").agg(F.max("timestamp").alias("_mx"))
    cen = lab.join(latest, "group").withColumn("is_central_news", F.col("timestamp") == F.col("_mx"))
    return R.representative(cen).select("group", "id")


@register("rnk4_best_per_topic", NEWS + """
SELECT source AS topic, max(id) AS id, arg_max(title, id) AS title FROM news_like GROUP BY source""")
def rnk4(spark, sf):
    n = X.news_like(spark, sf).withColumn("topic", F.col("source")).withColumn("importance", F.lit(1))
    return R.best_per_topic(n).select("topic", "id", "title")


# ---- 2.8 sets -------------------------------------------------------------------------
@register("set2_concat", NEWS + f"""
SELECT id FROM news_like WHERE {_win_sql(X.DIGEST_DAYS)}
UNION ALL
SELECT id FROM news_like WHERE "timestamp" <= {AT_SQL} - INTERVAL {X.HORIZON_DAYS} DAY""")
def set2(spark, sf):
    n = X.news_like(spark, sf)
    return R.concat_frames(R.time_window(n, X.AT, X.DIGEST_DAYS).select("id"),
                           R.before_horizon(n, X.AT, X.HORIZON_DAYS).select("id"))


@register("set3_distinct_ids", NEWS + """
SELECT DISTINCT n.id FROM (SELECT unnest(refers_to) AS link FROM news_like) r JOIN news_like n ON n.link = r.link""")
def set3(spark, sf):
    n = X.news_like(spark, sf)
    cited = n.select(F.explode("refers_to").alias("link"))
    return R.distinct_ids(cited.join(n.select("link", "id"), "link"), "id")


@register("set4_intersects", CODES + f"""
SELECT news_id, bool_or(list_contains({USER_SQL}, okved)) AS hit FROM news_codes GROUP BY news_id""")
def set4(spark, sf):
    per = X.news_codes_like(spark, sf).groupBy("news_id").agg(F.collect_list("okved").alias("okveds"))
    return per.select("news_id", R.intersects("okveds", F.array(*[F.lit(c) for c in X.USER_CODES])).alias("hit"))


@register("set5_minus_self", NEWS + f"""
SELECT DISTINCT link FROM (SELECT unnest(refers_to) AS link FROM news_like WHERE {_win_sql(X.DIGEST_DAYS)})
WHERE link NOT IN (SELECT link FROM news_like WHERE {_win_sql(X.DIGEST_DAYS)})""")
def set5(spark, sf):
    w = R.time_window(X.news_like(spark, sf), X.AT, X.DIGEST_DAYS)
    pool = w.select(F.explode("refers_to").alias("link")).distinct()
    return R.minus_self(pool, w, "link").select("link")


# ---- 2.9 scalars ------------------------------------------------------------------------
@register("fn1_code_prefix", CODES + """
SELECT news_id, okved, split_part(okved, '.', 1) || CASE WHEN strpos(okved, '.') > 0
       THEN '.' || split_part(okved, '.', 2) ELSE '' END AS prefix2 FROM news_codes""")
def fn1(spark, sf):
    return X.news_codes_like(spark, sf).select("news_id", "okved", S.code_prefix("okved", 2).alias("prefix2"))


@register("fn2_code_slice", CODES + """
SELECT news_id, okved, array_to_string(string_split(okved, '.')[2:3], '.') AS part12 FROM news_codes""")
def fn2(spark, sf):
    return X.news_codes_like(spark, sf).select("news_id", "okved", S.code_slice("okved", 3, 1).alias("part12"))


_TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


@register("fn3_tokenize", f"""
SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '{_TOK}')) AS INTEGER) AS n_tokens,
       array_to_string(regexp_extract_all(lower(text), '{_TOK}'), '|') AS tokens
FROM documents""")
def fn3(spark, sf):
    d = read_table(spark, sf, "documents")
    t = S.tokenize("text")
    return d.select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, "|").alias("tokens"))


@register("fn4_clean_token", f"""
SELECT doc_id, array_to_string({X.sql_tokens('text')}, '|') AS tokens FROM documents""")
def fn4(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(S.clean_tokens("text"), "|").alias("tokens"))


@register("fn5_drop_empty", f"""
SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS INTEGER) AS n_words FROM documents""")
def fn5(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.size(S.drop_empty(F.split("text", " "))).alias("n_words"))


@register("fn9_index_params", """
SELECT n, CAST(round_even(sqrt(n), 0) AS BIGINT) AS nlist, CAST(floor(round_even(sqrt(n), 0) / 4) AS BIGINT) AS nprobe
FROM (SELECT count(*) AS n FROM documents)""")
def fn9(spark, sf):
    n = read_table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))
    nl = S.suggested_nlist("n")
    return n.select("n", nl.alias("nlist"), S.suggested_nprobe(nl).alias("nprobe"))


@register("fn10_time_slices", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, strftime(o_orderdate, '%Y-%m') AS ym,
       CAST(year(make_timestamp(CAST(epoch_ms(o_orderdate) * 1000 AS BIGINT))) AS INTEGER) AS y_from_ms
FROM orders""")
def fn10(spark, sf):
    o = read_table(spark, sf, "orders")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.select("o_orderkey", S.year_slice("o_orderdate").alias("y"), S.month_slice("o_orderdate").alias("ym"),
                    S.year_slice(S.ts_from_millis(ms)).alias("y_from_ms"))


@register("fn11_is_code_input", """
SELECT doc_id, coalesce(regexp_matches(split_part(text, chr(10), 1), '\\p{Nd}'), false) AS is_code FROM documents""")
def fn11(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", S.is_code_input(F.substring_index("text", "\n", 1)).alias("is_code"))


@register("fn12_map_lookup", X.with_ctes(X.SQL_NEWS_CODES, X.SQL_RELATED) + """,
rel AS (SELECT okved, array_to_string(list_sort(list(related)), ',') AS rel FROM related_codes GROUP BY okved),
codes AS (SELECT DISTINCT okved FROM news_codes)
SELECT c.okved, r.rel FROM codes c LEFT JOIN rel r ON r.okved = c.okved""")
def fn12(spark, sf):
    rel = X.related_codes_like(spark, sf).groupBy("okved").agg(
        F.array_join(F.array_sort(F.collect_list("related")), ",").alias("rel"))
    codes = X.news_codes_like(spark, sf).select("okved").distinct()
    # table form of the map lookup: a left join keeps misses as NULL
    return codes.join(rel, "okved", "left").select("okved", "rel")


# ---- JN15 / AGG12: topic spine and report ---------------------------------------------
from ..functions.wordlists import TOPIC_NAMES  # noqa: E402

_TOPICS = X._sql_list(TOPIC_NAMES)
_SPINE_SQL = NEWS_ROLES + f""",
pool AS (SELECT * FROM news_like WHERE {_win_sql(1)}
         AND source IN (SELECT source FROM role_sources WHERE role = '{X.ROLE}')),
scored AS (SELECT id, title, {_TOPICS}[id % 10 + 1] AS topic FROM pool),
best AS (SELECT topic, arg_max(title, id) AS title FROM scored GROUP BY topic),
names AS (SELECT CAST(i - 1 AS INTEGER) AS topic_pos, {_TOPICS}[i] AS topic FROM range(1, 11) t(i)),
spine AS (SELECT n.topic_pos, n.topic, coalesce(b.title, '-') AS title FROM names n LEFT JOIN best b ON b.topic = n.topic)
"""


def _spine(spark, sf):
    n = R.for_role(R.time_window(X.news_like(spark, sf), X.AT, 1), X.role_sources(spark), X.ROLE)
    names = F.array(*[F.lit(x) for x in TOPIC_NAMES])
    scored = n.select("id", "title", F.element_at(names, (F.col("id") % 10 + 1).cast("int")).alias("topic"),
                      F.lit(1).alias("importance"))
    best = R.best_per_topic(scored)
    spine_names = spark.createDataFrame(list(enumerate(TOPIC_NAMES)), "topic_pos int, topic string")
    return R.topics_spine(spine_names, best)


@register("jn15_topics_spine", _SPINE_SQL + "SELECT topic_pos, topic, title FROM spine")
def jn15(spark, sf):
    return _spine(spark, sf).select("topic_pos", "topic", "title")


@register("agg12_format_report", _SPINE_SQL + """
SELECT coalesce(string_agg('**' || topic || ':**' || chr(10) || title || chr(10) || chr(10), '' ORDER BY topic_pos)
       FILTER (WHERE title <> '-'), '') AS report FROM spine""")
def agg12(spark, sf):
    return R.format_report(_spine(spark, sf))
