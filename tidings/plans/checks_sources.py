"""Checked plans for sources / sinks (SRC*) and cleaning (CLN*).

File sinks write to a fresh folder below the shared checkpoint folder and
return the frame read back from it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as CL
from ..functions import extract as E
from ..operators import knn as K
from ..operators import relational as R
from ..session import read_table, scratch_path
from ..sources import io as IO
from . import fixtures as X
from .checks_extract import PLAIN_ENTITIES
from .registry import register

NEWS = X.with_ctes(X.SQL_NEWS_LIKE)
TS = X.sql_ts('"timestamp"')


def _news_out(df):
    return df.select("id", "link", "text", "title", "source", X.ts_str(F.col("timestamp")).alias("ts"),
                     F.array_join("refers_to", " ").alias("refs"))


_NEWS_OUT_SQL = NEWS + f"""
SELECT id, link, text, title, source, {TS} AS ts, array_to_string(refers_to, ' ') AS refs FROM news_like"""


@register("src1_read_news", _NEWS_OUT_SQL)
def src1(spark, sf):
    path = IO.write_news(X.news_like(spark, sf), scratch_path(spark, "news"))
    return _news_out(IO.read_news(spark, path))


@register("src3_write_news", _NEWS_OUT_SQL)
def src3(spark, sf):
    path = IO.write_news(X.news_like(spark, sf), scratch_path(spark, "news"))
    raw = spark.read.json(path, schema="id long, link string, text string, title string, source string, "
                                       "timestamp string, refers_to array<string>")
    return raw.select("id", "link", "text", "title", "source",
                      F.regexp_replace("timestamp", "T", " ").alias("ts"), F.array_join("refers_to", " ").alias("refs"))


@register("src2_read_mixed_json", NEWS + f"""
SELECT link, title, source, {TS} AS ts FROM news_like
UNION ALL SELECT link, title, source, {TS} FROM news_like
UNION ALL SELECT arg_max(link, id), arg_max(title, id), source, {X.sql_ts('arg_max("timestamp", id)')}
          FROM news_like GROUP BY source""")
def src2(spark, sf):
    news = X.news_like(spark, sf)
    root = scratch_path(spark, "landing")
    cols = ["link", "text", "title", "source", "timestamp", "refers_to"]
    with_id = news.withColumn("timestamp", CL.to_iso("timestamp"))
    raw = with_id.select(*cols)
    # one record per line
    raw.write.mode("overwrite").json(f"{root}/lines")
    # wrapped lists of a source and day (a crawler's daily dump), one per line and file
    lists = X.wrapped_lists(raw).repartition(64, F.xxhash64("value"))
    (lists.withColumn("file", F.hex(F.xxhash64("value"))).write.mode("overwrite")
     .partitionBy("source", "day", "file").text(f"{root}/wrapped"))
    # one single record per file: the latest article of each source
    latest = with_id.groupBy("source").agg(F.max_by(F.struct(*cols), "id").alias("r")).select("r.*")
    (latest.select("source", F.to_json(F.struct(*cols)).alias("value"))
     .write.mode("overwrite").partitionBy("source").text(f"{root}/single"))
    out = IO.read_mixed_json(spark, root, lines_glob="*.json", whole_glob="*.txt")
    return out.select("link", "title", "source", X.ts_str(CL.parse_iso("timestamp")).alias("ts"))


_TAX_SQL = """
SELECT lpad(CAST(doc_id % 97 AS VARCHAR), 2, '0') || '.' || CAST(doc_id AS VARCHAR) AS Kod,
       split_part(text, chr(10), 1) AS Name, source AS SectionName,
       CASE WHEN n_chars % 3 = 0 THEN NULL ELSE text END AS Notes, doc_id
FROM documents"""


def _taxonomy_from_docs(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select(
        F.concat(F.lpad((F.col("doc_id") % 97).cast("string"), 2, "0"), F.lit("."),
                 F.col("doc_id").cast("string")).alias("Kod"),
        F.substring_index("text", "\n", 1).alias("Name"), F.col("source").alias("SectionName"),
        F.when(F.col("n_chars") % 3 == 0, F.lit(None)).otherwise(F.col("text")).alias("Notes"),
        "doc_id")


@register("src4_read_taxonomy", "SELECT Kod, Name, SectionName, Notes FROM (" + _TAX_SQL + ")")
def src4(spark, sf):
    path = IO.write_taxonomy(_taxonomy_from_docs(spark, sf), scratch_path(spark, "taxonomy"))
    return IO.read_taxonomy(spark, path)


@register("src5_write_csv_by_date", NEWS + f"""
SELECT id, title, strftime("timestamp", '%Y-%m-%d') AS day FROM news_like""")
def src5(spark, sf):
    path = IO.write_csv_by_date(X.news_like(spark, sf).select("id", "title", "timestamp"),
                                scratch_path(spark, "bydate"))
    back = spark.read.option("header", "true").schema("id long, title string, timestamp string, date date").csv(path)
    return back.select("id", "title", F.date_format("date", "yyyy-MM-dd").alias("day"))


@register("src6_code_map", X.with_ctes(X.SQL_NEWS_CODES) + """
SELECT DISTINCT news_id, split_part(okved, '.', 1) || '.' || split_part(okved, '.', 2) AS okved FROM news_codes""")
def src6(spark, sf):
    cs = R.code_set(X.news_codes_like(spark, sf))
    path = IO.write_code_map(cs, scratch_path(spark, "codemap"))
    return IO.read_code_map(spark, path)


@register("src8_read_roles", X.with_ctes(X.SQL_ROLES_OF_DOCS) + """
SELECT role, unnest(sources) AS value, 'source' AS kind FROM doc_roles
UNION ALL SELECT role, unnest(add_okveds), 'code' FROM doc_roles""")
def src8(spark, sf):
    # the role config is written from the roles of the documents, then read back
    path = IO.write_roles(X.roles_of_docs(spark, sf), scratch_path(spark, "roles"))
    roles = IO.read_roles(spark, path)
    return roles.select("role", F.explode("sources").alias("value"), F.lit("source").alias("kind")).unionByName(
        roles.select("role", F.explode("add_okveds").alias("value"), F.lit("code").alias("kind")))


@register("src9_read_texts", NEWS + "SELECT id, title FROM news_like")
def src9(spark, sf):
    path = scratch_path(spark, "texts")
    X.news_like(spark, sf).select("id", "title").write.parquet(path)
    return IO.read_texts(spark, path)


@register("src10_vector_store")
def src10(spark, sf):
    v = X.vectors(spark, sf)
    cells, centers, nlist, nprobe = K.build_index(v)
    path = IO.write_vectors(cells, centers, nlist, nprobe, 64, scratch_path(spark, "index"))
    vecs, _, _ = IO.read_vectors(spark, path)
    return vecs.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@register("src11_append_news", NEWS + f"""
SELECT link, title FROM news_like""")
def src11(spark, sf):
    news = X.news_like(spark, sf)
    table = scratch_path(spark, "news_table")
    IO.append_news(R.time_window(news, X.AT, 90), table)
    IO.append_news(news.join(R.time_window(news, X.AT, 90).select("id"), "id", "left_anti"), table)
    return spark.read.parquet(table).select("link", "title")


@register("src12_get_news", NEWS + "SELECT id, title FROM news_like WHERE id = (SELECT max(id) FROM news_like)")
def src12(spark, sf):
    news = X.news_like(spark, sf)
    return IO.get_news(news, news.select(F.max("id")).scalar()).select("id", "title")


_PROF_SQL = X.with_ctes(X.SQL_PROFILES) + """,
ch AS (SELECT id, seq, CASE WHEN state IN ('view', 'click') THEN NULL ELSE state END AS state,
              CASE WHEN state = 'click' THEN lpad(CAST(CAST(floor(value) AS BIGINT) % 20 AS VARCHAR), 2, '0') || '.1' END AS add_okved,
              state = 'error' AS reset_okveds
       FROM profiles_like),
r AS (SELECT id, max(CASE WHEN reset_okveds THEN seq END) AS rs FROM ch GROUP BY id)
SELECT ch.id, max(ch.seq) AS seq, coalesce(arg_max(ch.state, ch.seq) FILTER (WHERE ch.state IS NOT NULL), 'NEW') AS state,
       coalesce(array_to_string(list(ch.add_okved ORDER BY ch.seq) FILTER (WHERE ch.add_okved IS NOT NULL
                AND (r.rs IS NULL OR ch.seq >= r.rs)), ','), '') AS okveds
FROM ch JOIN r ON r.id = ch.id GROUP BY ch.id"""


@register("src13_merge_profiles", _PROF_SQL)
def src13(spark, sf):
    p = X.profiles_like(spark, sf)
    ch = p.select("id", "seq",
                  F.when(F.col("state").isin("view", "click"), F.lit(None)).otherwise(F.col("state")).alias("state"),
                  F.when(F.col("state") == "click",
                         F.concat(F.lpad((F.floor("value").cast("long") % 20).cast("string"), 2, "0"), F.lit(".1")))
                  .alias("add_okved"),
                  (F.col("state") == "error").alias("reset_okveds"))
    m = IO.merge_profiles(None, ch)
    return m.select("id", "seq", "state", F.array_join("okveds", ",").alias("okveds"))


@register("src14_write_landing", NEWS + """
SELECT id, source, strftime("timestamp", '%Y-%m-%d') AS day, title, link FROM news_like""")
def src14(spark, sf):
    path = IO.write_landing(X.news_like(spark, sf).drop("text"), scratch_path(spark, "landing"), mode="overwrite")
    back = spark.read.json(path, schema="id long, title string, link string, source string, date date")
    return back.select("id", "source", F.date_format("date", "yyyy-MM-dd").alias("day"), "title", "link")


# ---- cleaning ----------------------------------------------------------------------
_ENT_SQL = "html"
for _e, _c in PLAIN_ENTITIES:
    _ENT_SQL = f"replace({_ENT_SQL}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"
_HTML_SQL = "html"
for _tag in ("script", "style", "template"):
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
_HTML_SQL = f"regexp_replace(regexp_replace({_HTML_SQL}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
_HTML_TEXT_SQL = _ENT_SQL.replace("replace(html,", f"replace({_HTML_SQL},", 1)
_SPACE_SQL = "trim(regexp_replace({x}, '" + CL.SPACE_CLASS + "+', ' ', 'g'))"


@register("cln1_html_to_text", f"SELECT page_id, {_HTML_TEXT_SQL} AS text FROM pages")
def cln1(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", CL.html_to_text("html").alias("text"))


@register("cln1_html_to_text_strict")
def cln1s(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", CL.norm_space(CL.html_to_text_strict("html")).alias("text"))


@register("cln2_norm_space", f"SELECT page_id, {_SPACE_SQL.replace("{x}", _HTML_TEXT_SQL)} AS text FROM pages")
def cln2(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", CL.norm_space(CL.html_to_text("html")).alias("text"))


@register("cln3_norm_unicode", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def cln3(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", CL.norm_unicode("text").alias("text"))


_HREF = r"""<a[^>]*href="([^"]*)\""""


@register("cln4_resolve_urls", f"""
SELECT page_id, unnest(list_transform(regexp_extract_all(html, '{_HREF}', 1), lambda x: CASE
  WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN x
  WHEN starts_with(x, '//') THEN regexp_extract(url, '{CL.URI_PATTERN}', 2) || ':' || x
  WHEN starts_with(x, '/') THEN regexp_extract(url, '{CL.URI_PATTERN}', 2) || ':' || regexp_extract(url, '{CL.URI_PATTERN}', 3) || x
  WHEN starts_with(x, '?') THEN regexp_extract(url, '{CL.URI_PATTERN}', 2) || ':' || regexp_extract(url, '{CL.URI_PATTERN}', 3)
       || regexp_extract(url, '{CL.URI_PATTERN}', 5) || x
  WHEN starts_with(x, '#') THEN regexp_extract(url, '{CL.URI_PATTERN}', 2) || ':' || regexp_extract(url, '{CL.URI_PATTERN}', 3)
       || regexp_extract(url, '{CL.URI_PATTERN}', 5) || regexp_extract(url, '{CL.URI_PATTERN}', 6) || x
  WHEN x = '' THEN regexp_extract(url, '{CL.URI_PATTERN}', 2) || ':' || regexp_extract(url, '{CL.URI_PATTERN}', 3)
       || regexp_extract(url, '{CL.URI_PATTERN}', 5) || regexp_extract(url, '{CL.URI_PATTERN}', 6)
  ELSE regexp_extract(url, '{CL.URI_PATTERN}', 2) || ':' || regexp_extract(url, '{CL.URI_PATTERN}', 3)
       || CASE WHEN regexp_extract(url, '{CL.URI_PATTERN}', 5) = '' THEN '/'
               ELSE regexp_replace(regexp_extract(url, '{CL.URI_PATTERN}', 5), '[^/]*$', '') END || x
  END)) AS link FROM pages""")
def cln4(spark, sf):
    p = read_table(spark, sf, "pages")
    hrefs = E.extract_links("html")
    return p.select("page_id", F.explode(CL.resolve_urls("url", hrefs)).alias("link"))


@register("cln5_parse_iso_offset", NEWS + """
SELECT id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS moscow, strftime("timestamp" + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS utc
FROM news_like""")
def cln5_offset(spark, sf):
    s = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    n = X.news_like(spark, sf).select("id", F.concat(s, F.lit("+03:00")).alias("m"), F.concat(s, F.lit("Z")).alias("u"))
    return n.select("id", X.ts_str(CL.parse_iso("m")).alias("moscow"), X.ts_str(CL.parse_iso("u")).alias("utc"))


@register("cln5_parse_iso", NEWS + f"SELECT id, {X.sql_ts('try_cast(strftime(\"timestamp\", \'%Y-%m-%dT%H:%M:%S\') AS TIMESTAMP)')} AS ts FROM news_like")
def cln5(spark, sf):
    n = X.news_like(spark, sf).select("id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("s"))
    return n.select("id", X.ts_str(CL.parse_iso("s")).alias("ts"))


@register("cln6_clamp_epoch", """
SELECT o_orderkey, strftime(greatest(o_orderdate - INTERVAL 9500 DAY, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS ts
FROM orders""")
def cln6(spark, sf):
    o = read_table(spark, sf, "orders")
    shifted = F.col("o_orderdate").cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(9500))
    return o.select("o_orderkey", X.ts_str(CL.clamp_epoch(shifted)).alias("ts"))


@register("cln7_dense_id", """
SELECT doc_id, CAST(row_number() OVER (ORDER BY source, doc_id) - 1 AS BIGINT) AS dense_id FROM documents""")
def cln7(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    return CL.with_dense_id(d, ["source", "doc_id"], "dense_id").select("doc_id", "dense_id")


@register("cln8_to_iso", """
SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso FROM events""")
def cln8(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", CL.to_iso(F.col("ts").cast("timestamp_ntz")).alias("iso"))


@register("cln9_validate_news", f"""
SELECT page_id, CASE
  WHEN url IS NULL THEN 'missing link'
  WHEN html IS NULL THEN 'missing text'
  WHEN NOT regexp_matches(url, '^https?://[^ /?#:@]+(:[0-9]+)?([/?#][^ ]*)?$') THEN 'bad url link'
  WHEN length(url) > 2083 THEN 'url too long link' END AS reason
FROM pages""")
def cln9(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", F.col("url").alias("link"), F.col("html").alias("text"))
    return p.select("page_id", CL.validation_reason(["link", "text"], "link").alias("reason"))


# Latin keep set for the driver corpus (en/fr/de/es); the default is Russian.
LATIN_KEEP = "abcdefghijklmnopqrstuvwxyzàâäçéèêëîïôöùûüÿñáíóúß- "
EN_STOP = ["the", "and", "of", "to", "in", "is", "it", "a", "an", "by", "on", "for", "with", "that", "this",
           "le", "la", "les", "de", "des", "et", "der", "die", "und", "el", "los", "y"]


def _clean_sql(fields: list[str]) -> str:
    keep_cls = "[^" + LATIN_KEEP.replace("-", "\\-") + "]"
    parts = " || ' ' || ".join(f"regexp_replace(lower(coalesce({f}, '')), '{keep_cls}', ' ', 'g')" for f in fields)
    stop = X._sql_list(EN_STOP)
    words = f"list_filter(string_split_regex(trim({parts}), ' +'), lambda w: w <> '' AND NOT list_contains({stop}, w))"
    return f"trim(regexp_replace(replace(array_to_string({words}, ' '), '-', ' '), ' +', ' ', 'g'))"


@register("cln10_clean_text", f"SELECT doc_id, {_clean_sql(['text'])} AS clean FROM documents")
def cln10(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", CL.clean_text(["text"], LATIN_KEEP, EN_STOP).alias("clean"))


@register("cln11_flatten_taxonomy",
          f"SELECT Kod, {_clean_sql(['SectionName', 'Name', 'Notes'])} AS flat FROM ({_TAX_SQL})")
def cln11(spark, sf):
    t = _taxonomy_from_docs(spark, sf)
    return t.select("Kod", CL.flatten_taxonomy(LATIN_KEEP, EN_STOP).alias("flat"))


@register("cln12_flatten_news", NEWS + f"SELECT id, {_clean_sql(['title', 'text'])} AS flat FROM news_like")
def cln12(spark, sf):
    n = X.news_like(spark, sf)
    return n.select("id", CL.flatten_news(LATIN_KEEP, EN_STOP).alias("flat"))


@register("cln13_taxonomy_label", f"SELECT Kod, lower(SectionName) || ' > ' || lower(Name) AS label FROM ({_TAX_SQL})")
def cln13(spark, sf):
    return _taxonomy_from_docs(spark, sf).select("Kod", CL.taxonomy_label().alias("label"))
