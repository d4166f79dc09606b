"""Checked plans for the topic models (TXT3, TXT6-TXT10, RNK9, Q8).

Model fits are iterative / randomised, so these are rows-only checks; the
tests assert invariants (mixtures sum to 1, one topic per document, ...).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import text as T
from ..session import stage_table
from . import fixtures as X
from . import queries as Q
from .registry import register

K_TOPICS = 10
ITER = 10


def _inputs(spark, sf):
    """Tokens, phrases, word vectors and the keyword lists that topics use."""
    td = X.token_docs_like(spark, sf)
    phrases = stage_table(T.fit_phrases(td, 20), "phrases")
    wv = stage_table(X.word_vectors_like(spark, sf), "word-vectors")
    return td, phrases, wv, Q.topic_lists(td, phrases, wv, 64)


def _td(spark, sf):
    return _inputs(spark, sf)[3]


def _models(spark, sf, td):
    return T.fit_topics(td, K_TOPICS, 3, 0.5, ITER, 42)


@register("txt3_fit_word2vec")
def txt3(spark, sf):
    _, wv = T.fit_word2vec(X.token_docs_like(spark, sf), 100, 5, 1, 42)
    return wv


@register("txt6_fit_lda")
def txt6(spark, sf):
    td = _td(spark, sf)
    cvm, lda = _models(spark, sf, td)
    mix = T.assign_topic(td, cvm, lda)
    return mix.select("doc_id", F.round(F.aggregate("mix", F.lit(0.0), lambda a, x: a + x), 6).alias("mix_sum"))


@register("txt7_assign_topic")
def txt7(spark, sf):
    td = _td(spark, sf)
    cvm, lda = _models(spark, sf, td)
    return T.assign_topic(td, cvm, lda).select("doc_id", "topic_idx", "topic")


@register("txt8_get_topics")
def txt8(spark, sf):
    td, phrases, wv, lists = _inputs(spark, sf)
    cvm, lda = _models(spark, sf, lists)
    return T.get_topics(td, phrases, wv, 64, cvm, lda).select("doc_id", "topic")


@register("txt9_topic_over_time")
def txt9(spark, sf):
    td = _td(spark, sf)
    cvm, lda = _models(spark, sf, td)
    mix = T.assign_topic(td, cvm, lda)
    news = X.news_like(spark, sf)
    slices = news.select(F.col("id").alias("doc_id"), S.month_slice("timestamp").alias("slice"))
    return T.topic_over_time(mix, slices).select("slice", "topic_idx", F.round("weight", 6).alias("weight"))


TD = X.with_ctes(X.SQL_TOKEN_DOCS, X.SQL_TOKPOS)


@register("txt10_doc_length", TD + "SELECT doc_id, CAST(len(tokens) AS INTEGER) AS length FROM token_docs")
def txt10_length(spark, sf):
    return T.doc_lengths(X.token_docs_like(spark, sf))


@register("txt10_term_frequency", TD + "SELECT token AS term, count(*) AS tf FROM tokpos GROUP BY token")
def txt10_tf(spark, sf):
    return T.term_frequencies(X.token_docs_like(spark, sf))


@register("txt10_topic_summary")
def txt10(spark, sf):
    td = _td(spark, sf)
    cvm, lda = _models(spark, sf, td)
    s = T.topic_summary(td, cvm, lda)
    return s["doc_topic"].select("doc_id", F.posexplode("mix").alias("topic", "weight")).join(
        s["doc_length"], "doc_id")


@register("txt10_topic_term")
def txt10_terms(spark, sf):
    td = _td(spark, sf)
    cvm, lda = _models(spark, sf, td)
    return T.topic_summary(td, cvm, lda)["topic_term"]


@register("rnk9_topic_terms")
def rnk9(spark, sf):
    td = _td(spark, sf)
    cvm, lda = _models(spark, sf, td)
    return T.topic_terms(cvm, lda, 10).select("topic", "rank", "term", F.round("w", 6).alias("w"))


@register("q8_build_topics")
def q8(spark, sf):
    phrases, wv, cvm, lda = Q.build_topics(X.token_docs_like(spark, sf), 20, K_TOPICS, 3, 0.5, 100, ITER, 42)
    return T.topic_terms(cvm, lda, 10).select("topic", "rank", "term")
