"""Checked plans for token statistics, phrases, word vectors and keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.wordlists import EXCLUDED_POS
from ..operators import relational as R
from ..operators import text as T
from . import fixtures as X
from .checks_sources import EN_STOP, LATIN_KEEP
from .registry import register

TD = X.with_ctes(X.SQL_TOKEN_DOCS, X.SQL_TOKPOS)
TDW = X.with_ctes(X.SQL_TOKEN_DOCS, X.SQL_TOKPOS, X.SQL_WORD_VECTORS)
MIN_COUNT = 20
NO_BELOW = 3
DIMS = 64
r6, sql_r6 = X.r6, X.sql_r6


def _td(spark, sf):
    return X.token_docs_like(spark, sf)


@register("agg8_doc_freq", TD + """
SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, token AS term FROM tokpos) GROUP BY term""")
def agg8(spark, sf):
    return T.doc_freq(_td(spark, sf))


_DICT_SQL = TD + f""",
dfreq AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, token AS term FROM tokpos) GROUP BY term),
kept AS (SELECT * FROM dfreq WHERE df >= {NO_BELOW} AND df / (SELECT count(*) FROM token_docs) <= 0.5),
dict AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS term_id FROM kept)
"""


def _dict(spark, sf, td):
    n = td.select(F.count(F.lit(1))).scalar()
    return T.filter_extremes(T.doc_freq(td), n, NO_BELOW, 0.5)


@register("txt5_filter_extremes", _DICT_SQL + "SELECT term, df FROM kept")
def txt5(spark, sf):
    td = _td(spark, sf)
    return _dict(spark, sf, td)


@register("agg9_doc2bow", _DICT_SQL + """
SELECT t.doc_id, d.term_id, count(*) AS cnt FROM tokpos t JOIN dict d ON d.term = t.token GROUP BY t.doc_id, d.term_id""")
def agg9(spark, sf):
    td = _td(spark, sf)
    d = T.dictionary(_dict(spark, sf, td))
    return T.doc2bow(td, d).select("doc_id", "term_id", "cnt")


@register("agg10_corpus_stats", TD + """
SELECT (SELECT count(*) FROM token_docs) AS n_docs,
       (SELECT CAST(coalesce(sum(len(tokens)), 0) AS BIGINT) FROM token_docs) AS n_positions,
       (SELECT count(DISTINCT token) FROM tokpos) AS n_unique,
       (SELECT count(*) FROM (SELECT DISTINCT doc_id, token FROM tokpos)) AS n_nonzero""")
def agg10(spark, sf):
    return T.corpus_stats(_td(spark, sf))


@register("txt1_fit_phrases", TD + f""",
uni AS (SELECT token AS w, count(*) AS n FROM tokpos GROUP BY token),
bi AS (SELECT a, b, count(*) AS n_ab FROM
       (SELECT unnest(tokens[1:len(tokens) - 1]) AS a, unnest(tokens[2:]) AS b FROM token_docs) GROUP BY a, b),
v AS (SELECT (SELECT count(*) FROM uni) + (SELECT count(*) FROM bi) AS v)
SELECT a, b, n_ab, {sql_r6(f'(n_ab - {float(MIN_COUNT)}) / (ua.n * ub.n) * v.v')} AS score
FROM bi JOIN uni ua ON ua.w = bi.a JOIN uni ub ON ub.w = bi.b, v
WHERE (n_ab - {float(MIN_COUNT)}) / (ua.n * ub.n) * v.v > 10.0""")
def txt1(spark, sf):
    p = T.fit_phrases(_td(spark, sf), MIN_COUNT, 10.0)
    return p.select("a", "b", "n_ab", r6(F.col("score")).alias("score"))


_PHRASE_SQL = TD.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
uni AS (SELECT token AS w, count(*) AS n FROM tokpos GROUP BY token),
bi AS (SELECT a, b, count(*) AS n_ab FROM
       (SELECT unnest(tokens[1:len(tokens) - 1]) AS a, unnest(tokens[2:]) AS b FROM token_docs) GROUP BY a, b),
v AS (SELECT (SELECT count(*) FROM uni) + (SELECT count(*) FROM bi) AS v),
ph AS (SELECT a, b FROM bi JOIN uni ua ON ua.w = bi.a JOIN uni ub ON ub.w = bi.b, v
       WHERE (n_ab - {float(MIN_COUNT)}) / (ua.n * ub.n) * v.v > 10.0),
nxt AS (SELECT doc_id, pos, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS follower FROM tokpos),
cand AS (SELECT doc_id, pos FROM nxt JOIN ph ON ph.a = nxt.token AND ph.b = nxt.follower),
runs AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM cand),
taken AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS k FROM runs)
          WHERE k % 2 = 1),
words AS (SELECT n.doc_id, n.pos, CASE WHEN t.pos IS NULL THEN n.token ELSE n.token || '_' || n.follower END AS tok
          FROM nxt n LEFT JOIN taken t ON t.doc_id = n.doc_id AND t.pos = n.pos
          LEFT JOIN taken s ON s.doc_id = n.doc_id AND s.pos = n.pos - 1 WHERE s.pos IS NULL)
"""


@register("txt2_apply_phrases", _PHRASE_SQL + """
SELECT d.doc_id, CAST(count(w.tok) AS INTEGER) AS n, coalesce(string_agg(w.tok, ' ' ORDER BY w.pos), '') AS tokens
FROM token_docs d LEFT JOIN words w ON w.doc_id = d.doc_id GROUP BY d.doc_id""")
def txt2(spark, sf):
    td = _td(spark, sf)
    out = T.apply_phrases(td, T.fit_phrases(td, MIN_COUNT, 10.0), "replace")
    return out.select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@register("jn11_join_word_vectors", TDW + """
SELECT t.doc_id, CAST(count(*) AS BIGINT) AS n_known FROM tokpos t JOIN word_vectors w ON w.word = t.token GROUP BY t.doc_id""")
def jn11(spark, sf):
    rows = T.token_rows(_td(spark, sf))
    j = R.join_word_vectors(rows, X.word_vectors_like(spark, sf))
    return j.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_known"))


_LEMMA_SQL = """
lemmas AS (SELECT token AS word, regexp_replace(token, '(ing|ly|es|s)$', '') AS lemma,
           CASE WHEN length(token) <= 4 THEN 'PREP' WHEN suffix(token, 'ing') THEN 'VERB'
                WHEN suffix(token, 'ly') THEN 'ADVB' ELSE 'NOUN' END AS pos
           FROM (SELECT DISTINCT token FROM tokpos))"""


def _lemmas(spark, sf):
    w = T.token_rows(_td(spark, sf)).select("token").distinct()
    pos = (F.when(F.length("token") <= 4, "PREP").when(F.col("token").endswith("ing"), "VERB")
           .when(F.col("token").endswith("ly"), "ADVB").otherwise("NOUN"))
    return w.select(F.col("token").alias("word"), F.regexp_replace("token", "(ing|ly|es|s)$", "").alias("lemma"), pos.alias("pos"))


@register("jn12_lemmatise", TD.rstrip() + "," + _LEMMA_SQL + f"""
SELECT t.doc_id, string_agg(coalesce(l.lemma, t.token), ' ' ORDER BY t.pos) AS lemmas
FROM tokpos t LEFT JOIN lemmas l ON l.word = t.token
WHERE l.pos IS NULL OR NOT list_contains({X._sql_list(EXCLUDED_POS)}, l.pos)
GROUP BY t.doc_id""")
def jn12(spark, sf):
    rows = R.lemmatise(T.token_rows(_td(spark, sf)), _lemmas(spark, sf), EXCLUDED_POS)
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("l")).select(
        "doc_id", F.array_join(F.transform("l", lambda x: x["token"]), " ").alias("lemmas"))


@register("jn13_drop_stopwords", TD + f"""
SELECT doc_id, count(*) AS n FROM tokpos WHERE NOT list_contains({X._sql_list(EN_STOP)}, token) GROUP BY doc_id""")
def jn13(spark, sf):
    stop = spark.createDataFrame([(w,) for w in EN_STOP], "word string")
    rows = R.drop_stopwords(T.token_rows(_td(spark, sf)), stop)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


_DV_SQL = TDW + f""",
hits AS (SELECT t.doc_id, t.pos, t.token, w.vec FROM tokpos t JOIN word_vectors w ON w.word = t.token),
unit AS (SELECT doc_id, list_transform(vec, lambda x: CAST(x AS DOUBLE) / sqrt({X.sql_dot('vec', 'vec')})) AS u FROM hits),
el AS (SELECT doc_id, unnest(range(1, 65)) AS i, unnest(u) AS x FROM unit),
m AS (SELECT doc_id, i, avg(x) AS m FROM el GROUP BY doc_id, i),
dv AS (SELECT d.doc_id, coalesce((SELECT list(m.m ORDER BY m.i) FROM m WHERE m.doc_id = d.doc_id),
                               list_transform(range(1, 65), lambda k: 0.0)) AS dvec FROM token_docs d)
"""


@register("agg13_doc_vector", _DV_SQL + f"""
SELECT doc_id, {sql_r6('dvec[1]')} AS d1, {sql_r6('sqrt(' + X.sql_dot('dvec', 'dvec') + ')')} AS dnorm FROM dv""")
def agg13(spark, sf):
    dv = T.doc_vector(_td(spark, sf), X.word_vectors_like(spark, sf), DIMS)
    return dv.select("doc_id", r6(F.col("dvec")[0]).alias("d1"), r6(S.l2_norm("dvec")).alias("dnorm"))


_KW_SQL = _DV_SQL + f""",
occ AS (SELECT h.doc_id, h.pos, h.token,
        CASE WHEN {X.sql_dot('dv.dvec', 'dv.dvec')} = 0 THEN 0.0 ELSE
          {X.sql_dot('dv.dvec', 'h.vec')} / (sqrt({X.sql_dot('dv.dvec', 'dv.dvec')}) * sqrt({X.sql_dot('h.vec', 'h.vec')})) END AS cos
        FROM hits h JOIN dv ON dv.doc_id = h.doc_id),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cos DESC, pos DESC) AS r FROM occ),
kw AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(token))), ',') AS kw FROM top WHERE r <= 5 GROUP BY doc_id)
"""


@register("rnk7_keywords", _KW_SQL + """
SELECT d.doc_id, coalesce(kw.kw, array_to_string(d.tokens, ',')) AS keywords
FROM token_docs d LEFT JOIN kw ON kw.doc_id = d.doc_id""")
def rnk7(spark, sf):
    kw = T.keywords(_td(spark, sf), X.word_vectors_like(spark, sf), DIMS, 5)
    return kw.select("doc_id", F.array_join("keywords", ",").alias("keywords"))


@register("txt4_add_keywords", X.with_ctes(X.SQL_NEWS_LIKE) + _KW_SQL.replace("WITH ", ", ", 1) + """
SELECT n.id, n.source, coalesce(kw.kw, array_to_string(d.tokens, ',')) AS keywords
FROM news_like n JOIN token_docs d ON d.doc_id = n.id LEFT JOIN kw ON kw.doc_id = d.doc_id""")
def txt4(spark, sf):
    kw = T.keywords(_td(spark, sf), X.word_vectors_like(spark, sf), DIMS, 5)
    out = T.add_keywords(X.news_like(spark, sf).select("id", "source"), kw)
    return out.select("id", "source", F.array_join("keywords", ",").alias("keywords"))


@register("agg14_mean_pool", TDW + f""",
tv AS (SELECT t.doc_id, w.vec, CASE WHEN length(t.token) > 2 THEN 1.0 ELSE 0.0 END AS mask
       FROM tokpos t JOIN word_vectors w ON w.word = t.token),
el AS (SELECT doc_id, mask, unnest(range(1, 65)) AS i, unnest(vec) AS x FROM tv),
s AS (SELECT doc_id, i, sum(CAST(x AS DOUBLE) * mask) AS s FROM el GROUP BY doc_id, i),
n AS (SELECT doc_id, sum(mask) AS n FROM tv GROUP BY doc_id),
p AS (SELECT s.doc_id, list(s.s / greatest(n.n, 1e-9) ORDER BY s.i) AS pooled FROM s JOIN n ON n.doc_id = s.doc_id GROUP BY s.doc_id)
SELECT doc_id, {sql_r6('pooled[1]')} AS p1, {sql_r6('sqrt(' + X.sql_dot('pooled', 'pooled') + ')')} AS pnorm FROM p""")
def agg14(spark, sf):
    rows = T.token_rows(_td(spark, sf)).join(X.word_vectors_like(spark, sf).withColumnRenamed("word", "token"), "token")
    tv = rows.select("doc_id", "vec", F.when(F.length("token") > 2, 1.0).otherwise(0.0).alias("mask"))
    p = T.mean_pool(tv, dims=DIMS)
    return p.select("doc_id", r6(F.col("pooled")[0]).alias("p1"), r6(S.l2_norm("pooled")).alias("pnorm"))


@register("vec1_vectorize")
def vec1(spark, sf):
    n = X.news_like(spark, sf)
    v = T.vectorize(n, "title", "id")
    return v.select("id", r6(S.l2_norm("vec")).alias("norm"))


@register("vec2_sentence_vector")
def vec2(spark, sf):
    from ..functions.clean import flatten_news
    n = X.news_like(spark, sf)
    v = T.sentence_vector(n, flatten_news(LATIN_KEEP, EN_STOP), "id")
    return v.select("id", r6(S.l2_norm("vec")).alias("norm"))
