"""Checked plans for page extraction (EXT1-EXT17) over the ``pages`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as CL
from ..functions import extract as E
from ..session import read_table
from . import fixtures as X
from .registry import register


# ---- SQL of its own: plain patterns, enough for the markup of the driver's pages ----
PLAIN_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"),
                  ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")]


def sql_html_text(x: str) -> str:
    for tag in ("script", "style", "template"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
    for ent, ch in PLAIN_ENTITIES:
        x = f"replace({x}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return x


def sql_space(x: str) -> str:
    return f"trim(regexp_replace({x}, '{CL.SPACE_CLASS}+', ' ', 'g'))"


def sql_inner(x: str, tag: str) -> str:
    return f"regexp_extract({x}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1)"


def sql_paragraphs(cont: str) -> str:
    return (f"list_transform(string_split_regex({cont}, '(?i)<p\\b[^>]*>')[2:], "
            f"lambda p: split_part(p, '</p>', 1))")


def sql_body(html: str) -> str:
    cont = f"regexp_replace({sql_inner(html, 'article')}, '(?is)<div\\b[^>]*>.*?</div>', '', 'g')"
    ps = f"list_transform({sql_paragraphs(cont)}, lambda q: {sql_space(sql_html_text('q'))})"
    return f"array_to_string(list_filter({ps}, lambda z: z <> ''), ' ')"


HREF = '<a[^>]*href="([^"]*)"'
HOST_SQL = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"


def _pages(spark, sf):
    return read_table(spark, sf, "pages")


@register("ext1_extract_title", f"SELECT page_id, {sql_space(sql_html_text(sql_inner('html', 'h1')))} AS title FROM pages")
def ext1(spark, sf):
    return _pages(spark, sf).select("page_id", E.extract_title("html").alias("title"))


@register("ext2_extract_body", f"SELECT page_id, {sql_body('html')} AS body FROM pages")
def ext2(spark, sf):
    return _pages(spark, sf).select("page_id", E.extract_body("html").alias("body"))


@register("ext2_extract_rules", f"""
SELECT page_id, {sql_space(sql_html_text(sql_inner('html', 'h1')))} AS title,
       {sql_space(sql_html_text(sql_inner('html', 'article')))} AS body,
       regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def ext2_rules(spark, sf):
    rules = spark.createDataFrame(
        [(None, "title", "text", "h1", None, None, None, False), (None, "body", "text", "article", None, None, None, False),
         (None, "lang", "attr", "html", None, None, "lang", False)],
        "site string, field string, mode string, tag string, attr string, value string, arg string, last boolean")
    pages = _pages(spark, sf).withColumn("site", E.host_of("url"))
    out = E.extract_by_rules(pages, rules, "site")
    return out.select("page_id", *[F.col("fields")[f].alias(f) for f in ("title", "body", "lang")])


@register("ext3_extract_links", f"""
SELECT page_id, unnest(regexp_extract_all({sql_inner('html', 'body')}, '{HREF}', 1)) AS href FROM pages""")
def ext3(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", F.explode(E.extract_links(E.inner("html", "body"))).alias("href"))


DENY = ["/the", "/of"]
_DIR_SQL = "regexp_extract(url, '^([^?#]*/)', 1)"


@register("ext4_filter_links", f"""
SELECT page_id, unnest(list_filter(list_transform(list_filter(regexp_extract_all(html, '{HREF}', 1), lambda x:
    NOT contains(x, 'mailto:') AND (starts_with(x, '/') OR (NOT contains(x, 'file://')
    AND NOT regexp_matches(x, '^[A-Za-z0-9]+$') AND x NOT IN ('/the', '/of')))),
  lambda x: CASE WHEN regexp_matches(x, '^[a-z]+:') THEN x WHEN starts_with(x, '/') THEN {HOST_SQL} || x
            WHEN starts_with(x, '#') THEN regexp_extract(url, '^([^#]*)', 1) || x ELSE {_DIR_SQL} || x END),
  lambda y: contains(y, '.') AND length(y) <= 2083)) AS link
FROM pages""")
def ext4(spark, sf):
    p = _pages(spark, sf)
    links = E.filter_links(E.extract_links("html"), "url", DENY)
    return p.select("page_id", F.explode(links).alias("link"))


@register("ext5_prepare_url", f"""
SELECT page_id, unnest(list_transform(regexp_extract_all(html, '{HREF}', 1), lambda x: CASE
    WHEN starts_with(x, 'http') OR starts_with(x, 'mailto:') OR starts_with(x, 'tel:') THEN x
    WHEN starts_with(x, '/') THEN {HOST_SQL} || x ELSE {HOST_SQL} || '/' || x END)) AS link
FROM pages""")
def ext5(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", F.explode(F.transform(E.extract_links("html"),
                                                     lambda x: E.prepare_url(x, E.host_of("url")))).alias("link"))


@register("ext6_first_link_per_p", f"""
SELECT page_id, array_to_string(list_filter(list_transform({sql_paragraphs(sql_inner('html', 'article'))},
    lambda p: regexp_extract(p, '{HREF}', 1)), lambda x: x <> ''), chr(10)) AS links FROM pages""")
def ext6(spark, sf):
    return _pages(spark, sf).select("page_id", E.first_link_per_p(E.inner("html", "article")).alias("links"))


@register("ext7_text_urls", f"""
SELECT page_id, unnest(regexp_extract_all('Read ' || url || ' and ' || {sql_inner('html', 'h1')},
    'https?://[-A-Za-z0-9.]+[.][a-z]+[A-Za-z0-9._/?=&#-]*', 0)) AS u FROM pages""")
def ext7(spark, sf):
    p = _pages(spark, sf)
    txt = F.concat(F.lit("Read "), F.col("url"), F.lit(" and "), E.inner("html", "h1"))
    return p.select("page_id", F.explode(E.text_urls(txt)).alias("u"))


@register("ext8_ids_from_links", f"""
SELECT DISTINCT {HOST_SQL} AS host, regexp_extract(u, '/([0-9]+)([?#/]|$)', 1) AS id
FROM (SELECT url, unnest([url]) AS u FROM pages) WHERE regexp_extract(u, '/([0-9]+)([?#/]|$)', 1) <> ''""")
def ext8(spark, sf):
    p = _pages(spark, sf).select(E.host_of("url").alias("host"), F.array("url").alias("links"))
    return E.ids_from_links(p, "links", ["host"])


@register("ext9_id_in_url", "SELECT page_id, regexp_extract(url, '([^/]*)/?$', 1) AS last FROM pages")
def ext9(spark, sf):
    return _pages(spark, sf).select("page_id", E.id_in_url("url").alias("last"))


@register("ext10_parse_site_ts", """
SELECT event_id,
  strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS dmy,
  strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ymd,
  strftime(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS ep,
  strftime(CAST(timezone('Europe/Moscow', make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000)::TIMESTAMPTZ) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ep_msk,
  strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS iso
FROM events""")
def ext10(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    s1 = F.date_format("ts", "dd.MM.yyyy HH:mm")
    s2 = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    s3 = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string")
    s4 = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+03:00"))
    return e.select("event_id",
                    X.ts_str(E.parse_site_ts(s1, "%d.%m.%Y %H:%M")).alias("dmy"),
                    X.ts_str(E.parse_site_ts(s2, "%Y-%m-%d %H:%M:%S")).alias("ymd"),
                    X.ts_str(E.parse_site_ts(s3, "epoch")).alias("ep"),
                    X.ts_str(E.parse_site_ts(s3, "epoch_msk")).alias("ep_msk"),
                    X.ts_str(E.parse_site_ts(s4, "iso")).alias("iso"))


@register("ext11_parse_ru_date", """
SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS ts FROM events""")
def ext11(spark, sf):
    from ..functions.wordlists import RU_MONTHS_GENITIVE
    e = read_table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    months = F.array(*[F.lit(m) for m in RU_MONTHS_GENITIVE])
    s = F.concat(F.dayofmonth("ts").cast("string"), F.lit(" "), F.element_at(months, F.month("ts")),
                 F.lit(" "), F.year("ts").cast("string"), F.lit(", "), F.date_format("ts", "HH:mm"))
    return e.select("event_id", X.ts_str(E.parse_ru_date(s)).alias("ts"))


_POST_SQL = """
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'simple' WHEN 'assistant' THEN 'news' ELSE role END AS type,
       text, split_part(text, chr(10), 1) AS title FROM conversations"""


def _posts(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn",
                    F.when(F.col("role") == "user", "simple").when(F.col("role") == "assistant", "news")
                    .otherwise(F.col("role")).alias("type"),
                    "text", F.substring_index("text", "\n", 1).alias("title"),
                    F.lit(None).cast("array<string>").alias("refers_to"))


@register("ext12_route_posts", f"""
SELECT conv_id, turn, CASE WHEN type = 'simple' THEN '' ELSE title END AS title,
       CAST(CASE WHEN type = 'simple' THEN len(regexp_extract_all(text, 'https?://[-A-Za-z0-9.]+[.][a-z]+[A-Za-z0-9._/?=&#-]*', 0)) ELSE 0 END AS INTEGER) AS n_links
FROM ({_POST_SQL}) WHERE type IN ('simple', 'news', 'review')""")
def ext12(spark, sf):
    r = E.route_posts(_posts(spark, sf))
    return r.select("conv_id", "turn", "title", F.size("refers_to").alias("n_links"))


@register("ext13_messages_to_news", """
SELECT 'https://t.me/' || 'conv' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS link,
       coalesce(nullif(CASE WHEN role = 'user' THEN text END, ''), nullif(CASE WHEN role <> 'user' THEN text END, '')) AS title,
       'https://x.example.com/' || CAST(conv_id AS VARCHAR) AS ref
FROM conversations
WHERE coalesce(nullif(CASE WHEN role = 'user' THEN text END, ''), nullif(CASE WHEN role <> 'user' THEN text END, '')) IS NOT NULL""")
def ext13(spark, sf):
    c = read_table(spark, sf, "conversations")
    msgs = c.select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("channel"),
        F.col("turn").alias("id"),
        F.when(F.col("role") == "user", F.col("text")).alias("text"),
        F.when(F.col("role") != "user", F.col("text")).alias("caption"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("date"),
        F.array(F.struct(F.lit("TEXT_LINK").alias("type"),
                         F.concat(F.lit("https://x.example.com/"), F.col("conv_id").cast("string")).alias("url")),
                F.struct(F.lit("MENTION").alias("type"), F.lit("@x").alias("url"))).alias("entities"))
    n = E.messages_to_news(msgs)
    return n.select("link", "title", F.explode("refers_to").alias("ref"))


@register("ext14_standardise", f"""
SELECT url AS link, {sql_space(sql_html_text(sql_inner('html', 'h1')))} AS title, {HOST_SQL} AS source FROM pages""")
def ext14(spark, sf):
    p = _pages(spark, sf).select("url", E.extract_title("html").alias("t"), E.host_of("url").alias("h"))
    return E.standardise(p, {"link": "url", "title": "t", "source": "h"})


@register("ext15_join_preview", f"""
SELECT p.page_id, p.url, a.title FROM pages p
JOIN (SELECT url, {sql_space(sql_html_text(sql_inner('html', 'h1')))} AS title FROM pages) a ON a.url = p.url""")
def ext15(spark, sf):
    p = _pages(spark, sf)
    previews = p.select("page_id", "url")
    articles = p.select(F.col("url"), E.extract_title("html").alias("title"))
    return E.join_preview(previews, articles).select("page_id", "url", "title")


_PARAMS_SQL = X.with_ctes(X.SQL_NEWS_LIKE) + """,
params AS (SELECT source, 'https://' || source || '.example.com/news/' AS base, '50' AS size, 'desc' AS sort,
                  CAST(CAST(substr(source, 4) AS INTEGER) % 3 AS VARCHAR) AS type,
                  CAST(CAST(substr(source, 4) AS INTEGER) % 2 AS VARCHAR) AS bloc,
                  CAST(min("timestamp") AS DATE) AS start, CAST(max("timestamp") AS DATE) AS "end"
           FROM news_like GROUP BY source)
"""


@register("ext16_crawl_plan", _PARAMS_SQL + """
SELECT source, strftime(day, '%Y-%m-%d') AS day,
       base || '?' || concat_ws('&', 'size=' || size, 'sort=' || sort,
                                CASE WHEN type <> '0' THEN 'type=' || type END,
                                CASE WHEN bloc <> '0' THEN 'bloc=' || bloc END,
                                'd=' || CAST(day(day) AS VARCHAR), 'm=' || CAST(month(day) AS VARCHAR),
                                'y=' || CAST(year(day) AS VARCHAR)) AS url
FROM (SELECT *, unnest(generate_series(start, "end", INTERVAL 1 DAY)) AS day FROM params)""")
def ext16(spark, sf):
    n = X.news_like(spark, sf)
    num = F.substring("source", 4, 10).cast("int")
    params = n.groupBy("source").agg(F.min("timestamp").cast("date").alias("start"),
                                     F.max("timestamp").cast("date").alias("end")).select(
        "source", F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/news/")).alias("base"),
        F.lit("50").alias("size"), F.lit("desc").alias("sort"), (num % 3).cast("string").alias("type"),
        (num % 2).cast("string").alias("bloc"), F.lit(None).cast("string").alias("cursor"), "start", "end")
    plan = E.crawl_plan(params)
    return plan.select("source", F.date_format("day", "yyyy-MM-dd").alias("day"), "url")


@register("ext17_date_spine", """
SELECT strftime(day, '%Y-%m-%d') AS day FROM (
  SELECT unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), INTERVAL 1 DAY)) AS day
  FROM orders)""")
def ext17(spark, sf):
    o = read_table(spark, sf, "orders").agg(F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("e"))
    return o.select(F.explode(E.date_spine("s", "e", descending=True)).alias("d")).select(
        F.date_format("d", "yyyy-MM-dd").alias("day"))
