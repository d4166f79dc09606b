"""Filters, joins, aggregations, ranking and set operators (2.4-2.8).

All are DataFrame -> DataFrame compositions; Catalyst pushes the filters to
the scan and AQE picks join strategies at run time, by the bytes of each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import _c, code_prefix


def _ts(at) -> Column:
    return at if isinstance(at, Column) else F.lit(str(at)).cast("timestamp_ntz")


# 2.4 Filters ------------------------------------------------------------------
def time_window(df: DataFrame, at, days: int, ts_col: str = "timestamp") -> DataFrame:
    """FLT1: ``at - days <= ts <= at`` (both ends inclusive)."""
    end = _ts(at)
    start = end - F.make_dt_interval(days=F.lit(days))
    return df.filter(F.col(ts_col).between(start, end))


def for_role(df: DataFrame, role_sources: DataFrame, role: str,
             source_col: str = "source") -> DataFrame:
    """FLT2: source in the role's list (semi join on a config-sized table)."""
    srcs = role_sources.filter(F.col("role") == role).select(F.col("source").alias("_src")).distinct()
    return df.join(srcs, F.col(source_col) == F.col("_src"), "left_semi")


def before_horizon(df: DataFrame, at, days: int = 30, ts_col: str = "timestamp") -> DataFrame:
    """FLT3: ``ts <= at - days``."""
    return df.filter(F.col(ts_col) <= _ts(at) - F.make_dt_interval(days=F.lit(days)))


def in_pool(df: DataFrame, pool: DataFrame, key: str = "id", pool_key: str | None = None) -> DataFrame:
    """FLT4: restrict to an id pool (semi join, pool may be large)."""
    pk = pool_key or key
    p = pool.select(F.col(pk).alias("_pk")).distinct()
    return df.join(p, F.col(key) == F.col("_pk"), "left_semi")


def codes_match(codes, user_codes) -> Column:
    """FLT5: article codes plus their level-1 prefixes overlap the user's codes."""
    c = _c(codes)
    with_prefix = F.concat(c, F.transform(c, lambda x: code_prefix(x, 1)))
    return F.coalesce(F.arrays_overlap(with_prefix, _c(user_codes)), F.lit(False))


def min_group_size(df: DataFrame, group_col: str, m: int) -> DataFrame:
    """FLT6: keep rows of groups with at least ``m`` members."""
    keep = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= m)
    return df.join(keep.select(group_col), group_col, "left_semi")


def near(pairs: DataFrame, max_dist: float, a: str = "id", b: str = "nid", d: str = "dist") -> DataFrame:
    """FLT7: neighbour is not the query itself and ``dist < max_dist``."""
    return pairs.filter((F.col(a) != F.col(b)) & (F.col(d) < max_dist))


def threshold_or_best(pairs: DataFrame, max_dist: float, rank_col: str = "rank",
                      d: str = "dist") -> DataFrame:
    """FLT8: ``dist <= t`` or the best match (rank 1)."""
    return pairs.filter((F.col(rank_col) == 1) | (F.col(d) <= max_dist))


def _hash_hex(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")).cast("binary"))


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """FLT9: deterministic sample of n rows (hash order, TakeOrdered)."""
    return df.orderBy(_hash_hex(key, seed), F.col(key)).limit(n)


def split(df: DataFrame, test_fraction: float, seed: int = 42, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """FLT10: stable train/test split by a hash bucket of the key."""
    bucket = F.conv(F.substring(_hash_hex(key, seed), 1, 7), 16, 10).cast("long") % 10_000 / 10_000.0
    return df.filter(bucket >= test_fraction), df.filter(bucket < test_fraction)


# 2.5 Joins --------------------------------------------------------------------
def attach_codes(news: DataFrame, codes: DataFrame, id_col: str = "id") -> DataFrame:
    """JN1: article x codes by id (codes bridge is (news_id, okved))."""
    return news.join(codes, news[id_col] == codes["news_id"], "inner").drop("news_id")


def link_to_id(news: DataFrame, links: DataFrame, link_col: str = "link") -> DataFrame:
    """JN2: link -> id, the last (largest) id wins on duplicate links."""
    last = news.groupBy(F.col("link").alias("_lk")).agg(F.max("id").alias("id"))
    return links.join(last, F.col(link_col) == F.col("_lk"), "inner").drop("_lk")


def id_to_link(ids: DataFrame, news: DataFrame, id_col: str = "id") -> DataFrame:
    """JN3: id -> link."""
    return ids.join(news.select(F.col("id").alias("_id"), "link"), F.col(id_col) == F.col("_id")).drop("_id")


def effective_codes(user_codes: DataFrame, related: DataFrame | None = None,
                    role_codes: DataFrame | None = None) -> DataFrame:
    """JN4 + JN5 + SET1: level-2 user codes, their related codes (one hop from
    the user's codes only) and the role's extra codes, as distinct rows."""
    base = user_codes.select(code_prefix("okved", 2).alias("okved")).distinct()
    out = base
    if related is not None:
        rel = base.join(related, "okved").select(F.col("related").alias("okved"))
        out = out.unionByName(rel)
    if role_codes is not None:
        out = out.unionByName(role_codes.select("okved"))
    return out.distinct()


def join_word_vectors(tokens: DataFrame, word_vectors: DataFrame, token_col: str = "token") -> DataFrame:
    """JN11: token x word vector; out-of-vocabulary tokens drop out."""
    return tokens.join(word_vectors.withColumnRenamed("word", token_col), token_col, "inner")


def lemmatise(tokens: DataFrame, lemmas: DataFrame, excluded_pos: list[str],
              token_col: str = "token") -> DataFrame:
    """JN12: token -> lemma via a dictionary join; words whose part of speech
    is excluded are dropped; unknown words are kept as they are."""
    d = lemmas.select(F.col("word").alias(token_col), F.col("lemma").alias("_lemma"), F.col("pos").alias("_pos"))
    j = tokens.join(d, token_col, "left")
    return (j.filter(F.col("_pos").isNull() | ~F.col("_pos").isin(excluded_pos))
             .withColumn(token_col, F.coalesce(F.col("_lemma"), F.col(token_col)))
             .drop("_lemma", "_pos"))


def drop_stopwords(tokens: DataFrame, stop: DataFrame, token_col: str = "token") -> DataFrame:
    """JN13: anti join with a stop-word table."""
    return tokens.join(stop.select(F.col("word").alias(token_col)), token_col, "left_anti")


def topics_spine(topics: DataFrame, best: DataFrame, topic_col: str = "topic") -> DataFrame:
    """JN15: every topic in the fixed list, '-' when it has no article."""
    return (topics.join(best, topic_col, "left")
            .withColumn("title", F.coalesce(F.col("title"), F.lit("-"))))


# 2.6 Aggregations -------------------------------------------------------------
def _span_seconds(ts_col: str) -> Column:
    """max - min of a timestamp column in seconds (microsecond exact)."""
    return (F.unix_micros(F.max(ts_col).cast("timestamp"))
            - F.unix_micros(F.min(ts_col).cast("timestamp"))) / 1e6


def cluster_stats(labeled: DataFrame, group_col: str = "group", ts_col: str = "timestamp") -> DataFrame:
    """AGG1: size and fractional-day span per group (0 for singletons)."""
    secs = _span_seconds(ts_col)
    return labeled.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("size"),
        (secs / 86400.0).alias("span_days"))


def rank_metrics(labeled: DataFrame, group_col: str = "group", ts_col: str = "timestamp") -> DataFrame:
    """AGG2: whole-day span, size and days/size per group."""
    secs = _span_seconds(ts_col)
    days = F.floor(secs / 86400).cast("long")
    return (labeled.groupBy(group_col)
            .agg(days.alias("days"), F.count(F.lit(1)).alias("size"))
            .withColumn("square", F.col("days") / F.col("size")))


def match_rate(flags: DataFrame, group_col: str, flag_col: str, min_rate: float = 0.5) -> DataFrame:
    """AGG3: mean of a boolean per group, keep groups with rate >= min_rate."""
    return (flags.groupBy(group_col).agg(F.avg(F.col(flag_col).cast("double")).alias("match_rate"))
            .filter(F.col("match_rate") >= min_rate))


def code_set(codes: DataFrame, id_col: str = "news_id", code_col: str = "okved") -> DataFrame:
    """AGG5: distinct level-2 prefixes per article (sorted)."""
    return codes.groupBy(id_col).agg(
        F.array_sort(F.collect_set(code_prefix(code_col, 2))).alias("okveds"))


def slice_counts(df: DataFrame, slice_col: Column, name: str = "slice") -> DataFrame:
    """AGG6: rows per time slice."""
    return df.groupBy(slice_col.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def time_extent(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """AGG7: min and max timestamp."""
    return df.agg(F.min(ts_col).alias("min_ts"), F.max(ts_col).alias("max_ts"))


def format_report(spine: DataFrame, order_col: str = "topic_pos", topic_col: str = "topic",
                  title_col: str = "title") -> DataFrame:
    """AGG12: one report string in fixed topic order, '-' topics skipped."""
    parts = spine.filter(F.col(title_col) != "-").select(
        F.struct(F.col(order_col), F.concat(F.lit("**"), F.col(topic_col), F.lit(":**\n"),
                                            F.col(title_col), F.lit("\n\n")).alias("s")).alias("p"))
    return parts.agg(F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list("p")),
                                                         lambda x: x["s"]), ""), F.lit("")).alias("report"))


# 2.7 Ranking ------------------------------------------------------------------
def top_clusters(stats: DataFrame, n: int | None = 3, group_col: str = "group") -> DataFrame:
    """RNK1: top-n groups by (size, span_days, label), all descending."""
    ordered = stats.orderBy(F.desc("size"), F.desc("span_days"), F.desc(group_col))
    return ordered if n is None else ordered.limit(n)


def rank_newsgroups(metrics: DataFrame, by: str = "square", n: int = 3, group_col: str = "group") -> DataFrame:
    """RNK2: rank groups by 'square' (days/size) or 'power' (size); stable."""
    if by not in ("square", "power"):
        raise ValueError("the parameter 'by' must be one of (square, power)")
    m = "square" if by == "square" else "size"
    return metrics.orderBy(F.desc(m), F.asc(group_col)).limit(n)


def representative(labeled: DataFrame, group_col: str = "group", central_col: str = "is_central_news",
                   id_col: str = "id") -> DataFrame:
    """RNK3: first (smallest id) central article of every group."""
    central = labeled.filter(F.col(central_col))
    w = Window.partitionBy(group_col).orderBy(F.col(id_col))
    return central.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def best_per_topic(df: DataFrame, topic_col: str = "topic", importance_col: str = "importance",
                   id_col: str = "id", title_col: str = "title") -> DataFrame:
    """RNK4: one title per topic by (importance, id) maximum."""
    return df.groupBy(topic_col).agg(
        F.max_by(F.col(title_col), F.struct(F.col(importance_col), F.col(id_col))).alias(title_col),
        F.max_by(F.col(id_col), F.struct(F.col(importance_col), F.col(id_col))).alias(id_col))


def topk_per_key(pairs: DataFrame, k: int, key: str = "id", order: list | None = None) -> DataFrame:
    """RNK6: first k rows per key (row_number <= k, planned as a group limit)."""
    order = order or [F.col("dist").asc(), F.col("nid").asc()]
    w = Window.partitionBy(key).orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# 2.8 Set operations -------------------------------------------------------------
def concat_frames(*dfs: DataFrame) -> DataFrame:
    """SET2."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def distinct_ids(df: DataFrame, col: str = "id") -> DataFrame:
    """SET3."""
    return df.select(col).distinct()


def intersects(a, b) -> Column:
    """SET4: non-empty intersection."""
    return F.coalesce(F.arrays_overlap(_c(a), _c(b)), F.lit(False))


def minus_self(pool: DataFrame, own: DataFrame, key: str = "link") -> DataFrame:
    """SET5: pool minus own rows."""
    return pool.join(own.select(key), key, "left_anti")


def importance(pairs: DataFrame, items: DataFrame, days: int = 3, ts_col: str = "timestamp",
               member: DataFrame | None = None) -> DataFrame:
    """RNK5: per article, the number of similar articles published within
    +-days; 0 when none.

    ``pairs`` (a < b) are between representatives and ``member`` (id, rep)
    names each article's; without ``member`` every article stands for itself.
    Articles are counted per representative and time: an event goes to the
    three buckets of ``days`` around it, an article looks into its own, and a
    range window inside (representative, bucket) counts them, so neither copies
    nor a long-lived hot group are paired up."""
    if member is None:
        member = items.select("id", F.col("id").alias("rep"))
    span = days * 86_400_000_000
    at = items.select("id", F.unix_micros(F.col(ts_col).cast("timestamp")).alias("_t")).join(member, "id")
    both = (pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            .unionByName(member.select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct()))
    bucket = F.floor(F.col("_t") / F.lit(span)).cast("long")
    events = (at.groupBy("rep", "_t").agg(F.count(F.lit(1)).alias("_w"))
              .join(both, F.col("rep") == F.col("b"))
              .select("a", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_k"), "_t", "_w",
                      F.lit(None).cast("long").alias("id")))
    asked = at.select(F.col("rep").alias("a"), bucket.alias("_k"), "_t", F.lit(0).cast("long").alias("_w"), "id")
    w = Window.partitionBy("a", "_k").orderBy("_t").rangeBetween(-span, span)
    counts = (events.unionByName(asked).withColumn("_n", F.sum("_w").over(w)).where("id is not null")
              .select("id", (F.col("_n") - 1).alias("importance")))  # without the article itself
    return (items.select("id").join(counts, "id", "left")
            .select("id", F.coalesce("importance", F.lit(0)).cast("long").alias("importance")))
