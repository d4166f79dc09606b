"""Views over the driver tables, written once for Spark and once as DuckDB SQL.

The same derivation on both sides lets every operator be checked against an
SQL oracle on identical input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

LINK_PREFIX = "https://x.example.com/"

# Fixed query parameters shared by the Spark plans and the SQL oracles.
AT = "2024-03-01 00:00:00"
DIGEST_DAYS = 7
TRENDS_DAYS = 60
HORIZON_DAYS = 30
ROLE = "entrepreneur"
USER_CODES = ["03.1", "07.2", "11.4"]

# Role configuration: role -> sources and extra codes (a config table).
ROLES = {
    "booker": {
        "sources": ["src0", "src3", "src6", "src9", "src12", "src15", "src18"],
        "add_okveds": ["74.50", "75.23", "91.20"],
    },
    "entrepreneur": {
        "sources": ["src1", "src3", "src5", "src7", "src9", "src11", "src13",
                    "src15", "src17", "src19", "src2", "src4"],
        "add_okveds": ["74.50", "91.11", "05.1"],
    },
}


def _link(c):
    return F.concat(F.lit(LINK_PREFIX), c.cast("string"))


def news_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> news records (id, link, text, title, source, timestamp, refers_to)."""
    d = read_table(spark, sf_dir, "documents")
    n = d.select(F.count(F.lit(1))).scalar()  # scalar subquery, planned once
    did = F.col("doc_id")
    ts = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
          + F.make_dt_interval(days=(did % 90).cast("int"), hours=(did % 24).cast("int")))
    return d.select(
        did.alias("id"),
        _link(did).alias("link"),
        F.col("text"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.col("source"),
        ts.alias("timestamp"),
        F.array(_link((did * 7 + 3) % n), _link((did * 11 + 5) % n)).alias("refers_to"),
    )


def roles_table(spark: SparkSession) -> DataFrame:
    rows = [(r, v["sources"], v["add_okveds"]) for r, v in ROLES.items()]
    return spark.createDataFrame(rows, "role string, sources array<string>, add_okveds array<string>")


def roles_of_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles worked out from ``documents``: sources by the length of their name
    and the codes of their articles."""
    d = read_table(spark, sf_dir, "documents").where("source is not null")
    code = F.concat(F.lpad((F.col("doc_id") % 20).cast("string"), 2, "0"), F.lit("."),
                    (F.col("doc_id") % 5).cast("string"))
    return d.groupBy(F.concat(F.lit("role"), F.length("source").cast("string")).alias("role")).agg(
        F.sort_array(F.collect_set("source")).alias("sources"), F.sort_array(F.collect_set(code)).alias("add_okveds"))


def role_sources(spark: SparkSession) -> DataFrame:
    return roles_table(spark).select("role", F.explode("sources").alias("source"))


def news_codes_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge (news_id, okved): two codes per article derived from its id."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("news_id"))
    c1 = F.concat(F.lpad((F.col("news_id") % 20).cast("string"), 2, "0"), F.lit("."),
                  (F.col("news_id") % 5).cast("string"))
    c2 = F.concat(F.lpad(((F.col("news_id") * 3) % 20).cast("string"), 2, "0"), F.lit("."),
                  (F.col("news_id") % 7).cast("string"), F.lit("."),
                  (F.col("news_id") % 3).cast("string"))
    return d.select("news_id", F.explode(F.array(c1, c2)).alias("okved"))


def related_codes_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(okved, related): each level-2 code is related to the next two codes
    of the same level-1 section."""
    codes = news_codes_like(spark, sf_dir).select(
        F.substring_index("okved", ".", 2).alias("okved")).distinct()
    sec = F.substring_index("okved", ".", 1)
    sub = F.substring_index("okved", ".", -1).cast("int")
    return codes.select(
        "okved",
        F.explode(F.array(
            F.concat(sec, F.lit("."), ((sub + 1) % 5).cast("string")),
            F.concat(sec, F.lit("."), ((sub + 2) % 5).cast("string")))).alias("related"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def taxonomy_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code vectors: all embeddings, code = label.NN form."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("code_id"),
        F.concat(F.lpad(F.col("label").cast("string"), 2, "0"), F.lit("."),
                 (F.col("vec_id") % 10).cast("string")).alias("code"),
        F.col("embedding").alias("vec"))


def profiles_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"),
                    F.col("event_type").alias("state"), "value", "ts")


#: Records of one list in a crawler's dump.
LIST_RECORDS = 200


def wrapped_lists(raw: DataFrame) -> DataFrame:
    """Crawler dumps of ``raw`` records: (source, day, value), a JSON object that
    wraps a list of at most about ``LIST_RECORDS`` records of a source and day."""
    day = F.substring("timestamp", 1, 10).alias("day")
    size = raw.groupBy("source", day).agg(F.ceil(F.count(F.lit(1)) / LIST_RECORDS).alias("_lists"))
    rows = raw.withColumn("day", day).join(size, ["source", "day"]).withColumn(
        "_list", F.pmod(F.xxhash64("link", "title"), F.col("_lists")))
    lists = rows.groupBy("source", "day", "_list").agg(F.collect_list(F.struct(*raw.columns)).alias("l"))
    return lists.select("source", "day", F.to_json(F.create_map("source", "l")).alias("value"))


# --- SQL (DuckDB) ------------------------------------------------------------

SQL_NEWS_LIKE = f"""
news_like AS (
  SELECT d.doc_id AS id,
         '{LINK_PREFIX}' || CAST(d.doc_id AS VARCHAR) AS link,
         d.text,
         split_part(d.text, chr(10), 1) AS title,
         d.source,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(d.doc_id % 90 AS INTEGER))
             + to_hours(CAST(d.doc_id % 24 AS BIGINT)) AS "timestamp",
         ['{LINK_PREFIX}' || CAST((d.doc_id * 7 + 3) % c.n AS VARCHAR),
          '{LINK_PREFIX}' || CAST((d.doc_id * 11 + 5) % c.n AS VARCHAR)] AS refers_to
  FROM documents d, (SELECT count(*) AS n FROM documents) c
)"""


def _sql_list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


SQL_ROLES = "roles AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT '{r}' AS role, {_sql_list(v['sources'])} AS sources, {_sql_list(v['add_okveds'])} AS add_okveds"
    for r, v in ROLES.items()) + "\n)"

SQL_ROLES_OF_DOCS = """
doc_roles AS (
  SELECT 'role' || CAST(length(source) AS VARCHAR) AS role, list(DISTINCT source) AS sources,
         list(DISTINCT lpad(CAST(doc_id % 20 AS VARCHAR), 2, '0') || '.' || CAST(doc_id % 5 AS VARCHAR)) AS add_okveds
  FROM documents WHERE source IS NOT NULL GROUP BY 1)"""

SQL_ROLE_SOURCES = "role_sources AS (SELECT role, unnest(sources) AS source FROM roles)"

SQL_NEWS_CODES = """
news_codes AS (
  SELECT doc_id AS news_id, unnest([
      lpad(CAST(doc_id % 20 AS VARCHAR), 2, '0') || '.' || CAST(doc_id % 5 AS VARCHAR),
      lpad(CAST((doc_id * 3) % 20 AS VARCHAR), 2, '0') || '.' || CAST(doc_id % 7 AS VARCHAR)
          || '.' || CAST(doc_id % 3 AS VARCHAR)]) AS okved
  FROM documents
)"""

SQL_RELATED = """
related_codes AS (
  SELECT okved, unnest([
      split_part(okved, '.', 1) || '.' || CAST((CAST(split_part(okved, '.', 2) AS INTEGER) + 1) % 5 AS VARCHAR),
      split_part(okved, '.', 1) || '.' || CAST((CAST(split_part(okved, '.', 2) AS INTEGER) + 2) % 5 AS VARCHAR)]) AS related
  FROM (SELECT DISTINCT split_part(okved, '.', 1) || '.' || split_part(okved, '.', 2) AS okved FROM news_codes)
)"""

SQL_VECTORS = "vectors AS (SELECT vec_id AS id, embedding AS vec, label FROM embeddings)"

SQL_TAXONOMY = """
taxonomy_like AS (
  SELECT vec_id AS code_id,
         lpad(CAST(label AS VARCHAR), 2, '0') || '.' || CAST(vec_id % 10 AS VARCHAR) AS code,
         embedding AS vec
  FROM embeddings
)"""

SQL_PROFILES = """
profiles_like AS (
  SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, event_type AS state, value, ts FROM events
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def sql_ts(expr: str) -> str:
    """Timestamp rendered as 'YYYY-MM-DD HH:MM:SS' (same as ``ts_str``)."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def ts_str(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sql_dist(a: str, b: str, dims: int = 64) -> str:
    """Squared L2 in double precision, summed in element order."""
    return (f"list_reduce(list_transform(range(1, {dims + 1}), lambda i: "
            f"(CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE)) * (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE))), "
            f"lambda x, y: x + y)")


def sql_dot(a: str, b: str, dims: int = 64) -> str:
    return (f"list_reduce(list_transform(range(1, {dims + 1}), lambda i: "
            f"CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)), lambda x, y: x + y)")


# --- token documents (FN3-FN5) and derived word resources --------------------
SQL_TOK_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
SQL_WORD_RUN = r"[\p{L}\p{N}_]+"


def sql_tokens(text: str) -> str:
    """DuckDB form of ``clean_tokens``."""
    w = ("CASE WHEN strpos(t, '_') > 0 THEN trim(regexp_replace(translate(t, '_ё', ' e'), ' +', ' ', 'g')) "
         "ELSE translate(t, 'ё', 'e') END")
    return (f"list_filter(list_transform(regexp_extract_all(lower(coalesce({text}, '')), '{SQL_WORD_RUN}'), "
            f"lambda t: {w}), lambda x: length(x) > 1 AND regexp_matches(x, '^\\p{{L}}'))")


SQL_TOKEN_DOCS = f"token_docs AS (SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents)"
SQL_TOKPOS = ("tokpos AS (SELECT doc_id, unnest(range(0, len(tokens))) AS pos, unnest(tokens) AS token "
              "FROM token_docs)")
# word vectors: every distinct token gets an embedding row chosen by its length
# and first character
SQL_WORD_VECTORS = """
word_vectors AS (
  SELECT w.word, e.embedding AS vec FROM
    (SELECT DISTINCT token AS word FROM tokpos) w
    JOIN embeddings e ON e.vec_id = (length(w.word) * 37 + ascii(w.word)) % (SELECT count(*) FROM embeddings)
)"""


def token_docs_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalars import clean_tokens
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", clean_tokens("text").alias("tokens"))


def word_vectors_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.text import distinct_words
    td = token_docs_like(spark, sf_dir)
    e = read_table(spark, sf_dir, "embeddings")
    n = e.select(F.count(F.lit(1))).scalar()
    words = distinct_words(td)
    words = words.withColumn("vec_id", (F.length("word") * 37 + F.ascii("word")) % n)
    return words.join(e.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("word", "vec")


def r6(c):
    """Round to 6 digits with negative zero folded into zero."""
    return F.round(c, 6) + F.lit(0.0)


def sql_r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"
