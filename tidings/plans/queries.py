"""End-to-end queries (Q1-Q9) as compositions of the operators.

Each returns a DataFrame; clustering, range joins, dense ids and model fits run
jobs of their own before it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as CL
from ..functions.wordlists import TOPIC_NAMES
from ..operators import cluster as C
from ..operators import graph as G
from ..operators import knn as K
from ..operators import relational as R
from ..operators import sparse as S
from ..operators import text as T
from ..session import stage_table
from ..sources import io as IO


def _codes_frame(spark: SparkSession, codes: list[str]) -> DataFrame:
    return spark.createDataFrame([(c,) for c in codes], "okved string")


def effective_user_codes(spark: SparkSession, roles: DataFrame, role: str, filter_type: str,
                         codes: list[str] | None, related: DataFrame | None) -> DataFrame | None:
    """SET1: None for the 'all' filter; else level-2 user codes, plus (for
    the contractor filter) related codes one hop away and the role's codes."""
    if filter_type == "all":
        return None
    if not codes:
        raise ValueError("empty okveds")
    user = _codes_frame(spark, codes)
    if filter_type == "my_okveds":
        return R.effective_codes(user)
    if filter_type == "my_and_contractor_okveds":
        role_codes = roles.filter(F.col("role") == role).select(F.explode("add_okveds").alias("okved"))
        return R.effective_codes(user, related, role_codes)
    raise ValueError(f"unknown filter {filter_type}")


def select_window(news: DataFrame, roles: DataFrame, at, role: str, days: int) -> DataFrame:
    """FLT1 + FLT2: time window (pushed to the scan) and the role's sources."""
    rs = roles.filter(F.col("role") == role).select("role", F.explode("sources").alias("source"))
    return R.for_role(R.time_window(news, at, days), rs, role)


def grouped_window(spark: SparkSession, news: DataFrame, roles: DataFrame, at, role: str, filter_type: str,
                   codes: list[str] | None, days: int, news_codes: DataFrame | None = None,
                   related: DataFrame | None = None, vectors: DataFrame | None = None,
                   t: float = 0.2, labels: DataFrame | None = None) -> DataFrame:
    """Articles of the window with ``group`` and ``is_central_news``.

    ``vectors`` (id, vec) are precomputed title vectors (build time); when
    absent the titles' bags of words are clustered, found by the inverted
    index.  ``labels`` (id, group, is_central_news) replaces clustering with
    given groups."""
    win = select_window(news, roles, at, role, days)
    if labels is not None:
        grouped = win.join(labels, "id")
    else:
        vecs = bags = None
        if vectors is not None:
            vecs = vectors.join(win.select("id"), "id", "left_semi")
        else:
            bags = stage_table(S.bag_vectors(win, "title"), "title-bags")
        grouped = C.group_news(win, vecs, 1, t, bags=bags)
    eff = effective_user_codes(spark, roles, role, filter_type, codes, related)
    if eff is not None:
        grouped = C.personalised_trends(grouped, news_codes, eff)
    return grouped


def top_groups(grouped: DataFrame, n: int | None = 3) -> DataFrame:
    """RNK1 over AGG1: (group, size, span_days) of the top-n groups."""
    return R.top_clusters(R.cluster_stats(grouped), n)


def digest(spark: SparkSession, news: DataFrame, roles: DataFrame, at, role: str, filter_type: str = "all",
           codes: list[str] | None = None, days: int = 7, top: int = 3, **kw) -> DataFrame:
    """Q1 (days=7) / Q2 (days=60): representative article of each top group."""
    grouped = grouped_window(spark, news, roles, at, role, filter_type, codes, days, **kw)
    tops = top_groups(grouped, top)
    # at most ``top`` rows: a proven bound
    rep = R.representative(grouped.join(F.broadcast(tops), "group"))
    return rep.select("id", "title", "link", "source", "timestamp", "group", "size", "span_days")


def trends_query(spark, news, roles, at, role, filter_type="all", codes=None, **kw) -> DataFrame:
    """Q2: the digest over 60 days."""
    return digest(spark, news, roles, at, role, filter_type, codes, days=60, **kw)


def future_pool(news: DataFrame, edges: DataFrame, near_ids: DataFrame, depth: int = 3) -> DataFrame:
    """Links of the similar articles -> citing articles up to ``depth`` hops
    (start link removed) -> ids (last id wins per link), distinct."""
    seeds = R.id_to_link(near_ids.select(F.col("nid").alias("id")).distinct(), news).select("link")
    reached = G.expand(edges, seeds, depth).select(F.col("node").alias("link")).distinct()
    return R.link_to_id(news, reached).select("id").distinct()


def insights(spark: SparkSession, news: DataFrame, roles: DataFrame, edges: DataFrame, topics: DataFrame | None,
             at, role: str, filter_type: str = "all", codes: list[str] | None = None, *,
             topic_model: tuple | None = None, importance_t: float | None = None,
             near: DataFrame | None = None, vectors: DataFrame | None = None,
             max_sq: float = 0.35, k: int = 100, horizon_days: int = 30,
             topic_names: list[str] = TOPIC_NAMES, **kw) -> tuple[DataFrame, DataFrame]:
    """Q3: (per-topic headline frame, one-row report).

    near: given (id, nid) neighbour pairs; otherwise the top groups' members
    are searched over all title vectors (k = 100, squared L2 < max_sq, self
    removed).  topics: (id, topic) for the pool articles; without it they are
    inferred from the pool's titles (TXT8) by ``topic_model`` = (phrases, word
    vectors, dims, dictionary, LDA).  With ``importance_t`` an article's
    importance is its number of similar pool articles within three days
    (RNK5) on the title vectors, else all count alike."""
    grouped = grouped_window(spark, news, roles, at, role, filter_type, codes, 7, vectors=vectors, **kw)
    members = grouped.join(F.broadcast(top_groups(grouped, 3).select("group")), "group").select("id")
    if near is None:
        vecs = vectors if vectors is not None else stage_table(S.bag_vectors(news, "title"), "title-bags")
        search = K.near_rows if vectors is not None else S.near_rows
        near = search(vecs.join(members, "id", "left_semi"), vecs, k, max_sq).where("id <> nid")
    else:
        near = near.join(members, "id", "left_semi")
    pool_ids = future_pool(news, edges, near)
    pool = R.before_horizon(R.in_pool(news, pool_ids, "id"), at, horizon_days)
    if topics is None:
        phrases, wv, dims, cvm, lda = topic_model
        topics = T.get_topics(T.token_docs(pool, "id", "title"), phrases, wv, dims, cvm, lda).select(
            F.col("doc_id").alias("id"), "topic")
    scored = pool.join(topics, "id")
    if importance_t is None:
        scored = scored.withColumn("importance", F.lit(1))
    else:
        if vectors is not None:
            pairs, member = K.similar_classes(vectors.join(pool.select("id"), "id", "left_semi"), importance_t)
        else:
            pairs, member = S.similar_classes(S.bag_vectors(pool, "title"), importance_t, ids=pool)
        scored = scored.join(R.importance(pairs, pool.select("id", "timestamp"), 3, member=member), "id")
    best = R.best_per_topic(scored)
    spine_names = spark.createDataFrame(list(enumerate(topic_names)), "topic_pos int, topic string")
    spine = R.topics_spine(F.broadcast(spine_names), best)
    return spine.select("topic_pos", "topic", "title"), R.format_report(spine)


def build_corpus(spark: SparkSession, root: str, lines_glob: str = "*.jsonl", whole_glob: str = "*.json") -> DataFrame:
    """Q4: mixed JSON files -> cleaned records with dense ids (by link)."""
    raw = IO.read_mixed_json(spark, root, lines_glob, whole_glob)
    clean = raw.select(
        "link",
        CL.norm_unicode(CL.norm_space(CL.html_to_text("text"))).alias("text"),
        CL.norm_unicode(CL.norm_space("title")).alias("title"),
        "source",
        CL.clamp_epoch(CL.parse_iso("timestamp")).alias("timestamp"),
        CL.resolve_urls("link", F.coalesce("refers_to", F.array().cast("array<string>"))).alias("refers_to"))
    return CL.with_dense_id(clean, ["link", "timestamp", "title", "source", "text"], "id")


def build_tags(article_vecs: DataFrame, taxonomy_vecs: DataFrame, k: int = 100, max_sq: float = 0.62) -> DataFrame:
    """Q5: (news_id, okveds) - codes of the k nearest taxonomy vectors with
    squared L2 <= max_sq or the best one, cut to level 2, distinct."""
    nn = K.threshold_or_best_rows(article_vecs, taxonomy_vecs.select(F.col("code_id").alias("id"), "vec"), k, max_sq)
    pairs = nn.join(taxonomy_vecs.select(F.col("code_id").alias("nid"), "code"), "nid")
    return R.code_set(pairs.select(F.col("id").alias("news_id"), F.col("code").alias("okved")))


def build_index(vecs: DataFrame, path: str, dims: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q6: cells (k-means, nlist = round(sqrt n)) written partitioned by cell,
    with centres, radii and a parameter row; returns (vectors, centres, params) read back."""
    cells, centers, nlist, nprobe = K.build_index(vecs)
    cells = stage_table(cells, "index-cells")
    IO.write_vectors(cells, K.with_radii(cells, centers), nlist, nprobe, dims, path)
    return IO.read_vectors(vecs.sparkSession, path)


def build_topics(td: DataFrame, min_count: int = 20, k: int = 10, no_below: int = 3, no_above: float = 0.5,
                 w2v_size: int = 100, max_iter: int = 20, seed: int = 42):
    """Q8: phrases -> (append) -> word vectors -> ten keywords a document ->
    dictionary + LDA on the keyword lists, as inference uses them (TXT8)."""
    phrases = stage_table(T.fit_phrases(td, min_count), "phrases")
    _, wv = T.fit_word2vec(T.apply_phrases(td, phrases, "append"), w2v_size, seed=seed)
    wv = stage_table(wv, "word-vectors")
    lists = topic_lists(td, phrases, wv, w2v_size)
    cvm, lda = T.fit_topics(lists, k, no_below, no_above, max_iter, seed)
    return phrases, wv, cvm, lda


def topic_lists(td: DataFrame, phrases: DataFrame, wv: DataFrame, dims: int) -> DataFrame:
    """(doc_id, tokens): the ten keywords on which topics are learnt."""
    kw = T.keywords(T.apply_phrases(td, phrases, "replace"), wv, dims, 10)
    return stage_table(kw.select("doc_id", F.col("keywords").alias("tokens")), "keyword-lists")


def similar_stored(spark: SparkSession, path: str, asked: DataFrame, k: int = 100, max_sq: float = 0.35) -> DataFrame:
    """VEC5: (id, nid, dist, rank) of similar articles, searched in the stored
    index (Q6): only the cells that can hold one are read."""
    store, centers, _ = IO.read_vectors(spark, path)
    return K.near_rows_stored(asked, store, centers, k, max_sq).where("id <> nid")


def demo_similar(vecs: DataFrame, n: int = 10, k: int = 100, max_sq: float = 0.35, seed: int = 42,
                 index: str | None = None) -> DataFrame:
    """Q9: similar articles (ordered id list) for a deterministic sample; with
    ``index``, the path of the stored index, they are searched there."""
    sample = R.sample_n(vecs, n, seed)
    if index is not None:
        nn = similar_stored(vecs.sparkSession, index, sample, k, max_sq)
    else:
        nn = K.near_rows(sample, vecs, k, max_sq).where("id <> nid")
    return nn.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dist", "nid"))),
                                            lambda x: x["nid"]).alias("similar"))
