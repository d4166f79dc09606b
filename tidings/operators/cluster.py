"""Clustering at scale (CLU1-CLU5).  CLU1 and CLU2 work on an edge table of
similar pairs (JN14) and iterates Spark joins / aggregations.  Each round ends
with a reliable checkpoint, so a lost executor recomputes one round only.

* complete linkage: parallel merges of reciprocal nearest clusters (exact for
  reducible linkages; Murtagh 1983), cluster distances kept as edges below t;
  components of bounded size run all their rounds in one task;
* DBSCAN: degree -> core points -> connected components (min-label
  propagation with shortcutting) -> border points;
* micro-clusters: clustering-feature trees (``cftree``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage, forget_size
from . import knn, sparse
from .cftree import cluster_micro
from .relational import match_rate, min_group_size

#: Edges of a component of similar pairs that one task merges to the end.
LOCAL_EDGES = 1 << 20


# ---- connected components -------------------------------------------------------
def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "id",
                         src: str = "a", dst: str = "b") -> DataFrame:
    """(id, label) with label = smallest id of the component.

    Min-label propagation over undirected edges plus a shortcut step
    (label <- label(label)), rounds until no label changes.  The label table
    and the edge table are joined on keys; nothing is gathered per component.
    """
    und = (edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
           .unionByName(edges.select(F.col(dst).alias("u"), F.col(src).alias("v"))))
    und = forget_size(cut_lineage(und))
    labels = forget_size(cut_lineage(nodes.select(F.col(node).alias("u")).distinct().withColumn("lab", F.col("u"))))
    while True:
        # neighbour minimum
        nb = (und.join(labels.withColumnRenamed("u", "v").withColumnRenamed("lab", "nlab"), "v")
              .groupBy("u").agg(F.min("nlab").alias("nlab")))
        step = (labels.join(nb, "u", "left")
                .select("u", F.least("lab", F.coalesce("nlab", "lab")).alias("lab")))
        # shortcut: follow the label one hop
        hop = step.select(F.col("u").alias("lab"), F.col("lab").alias("lab2"))
        new = (step.join(hop, "lab", "left")
               .select("u", F.least("lab", F.coalesce("lab2", "lab")).alias("lab")))
        new = forget_size(cut_lineage(new))
        changed = (new.join(labels.withColumnRenamed("lab", "old"), "u")
                   .filter(F.col("lab") != F.col("old")).limit(1).count())
        labels = new
        if changed == 0:
            break
    return labels.select(F.col("u").alias(node), F.col("lab").alias("label"))


# ---- CLU2 DBSCAN -------------------------------------------------------------------
def cluster_dbscan(vecs: DataFrame | None, eps: float = 0.35, min_samples: int = 2, id_col: str = "id",
                   vec: str = "vec", metric: str = "cosine",
                   classes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id, label): label = smallest core id of the cluster, noise = -1.

    Neighbourhoods use ``dist <= eps``; a point is core when its neighbour
    count plus itself reaches ``min_samples``; border points take the smallest
    label among their core neighbours.  ``classes``: pairs at ``eps`` or nearer
    and membership, from ``sparse.similar_classes``, in place of ``vecs``."""
    # identical vectors are one point with a weight
    pairs, member = classes or knn.similar_classes(
        vecs.select(F.col(id_col).alias("id"), F.col(vec).alias("vec")), eps, metric=metric, inclusive=True)
    pairs = cut_lineage(pairs.select("a", "b"))
    weight = member.groupBy(F.col("rep").alias("id")).agg(F.count(F.lit(1)).alias("w"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    deg = (both.join(weight.select(F.col("id").alias("b"), "w"), "b")
           .groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("deg")))
    core = cut_lineage(weight.join(deg, "id", "left").where(
        F.col("w") + F.coalesce("deg", F.lit(0)) >= min_samples).select("id"))
    core_edges = (pairs.join(core.withColumnRenamed("id", "a"), "a", "left_semi")
                  .join(core.withColumnRenamed("id", "b"), "b", "left_semi"))
    core_lab = connected_components(core, core_edges)
    border = (both.join(core, both["a"] == core["id"], "left_anti")
              .join(core_lab.select(F.col("id").alias("b"), "label"), "b")
              .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("blabel")))
    labels = (weight.select("id").join(core_lab, "id", "left").join(border, "id", "left")
              .select(F.col("id").alias("rep"), F.coalesce("label", "blabel", F.lit(-1)).cast("long").alias("label")))
    return member.join(labels, "rep").select("id", "label")


def _follow(ids: DataFrame, merges: list[DataFrame]) -> DataFrame:
    """(id, label): every id led through all merges.  A cluster merges into a
    smaller label and is gone, so the merges are a forest and its components,
    with their smallest id, are the final clusters: one pass at the end in
    place of a rewrite of all labels in every round."""
    if not merges:
        return ids.select("id", F.col("id").alias("label"))
    edges = merges[0]
    for m in merges[1:]:
        edges = edges.unionByName(m)
    edges = cut_lineage(edges.select(F.col("new").alias("a"), F.col("old").alias("b")))
    return connected_components(ids, edges)


# ---- CLU1 complete linkage -------------------------------------------------------
def _all_rounds(schema: pa.Schema):
    """Kernel over whole components: the rounds of ``cluster_complete`` on
    arrays, until no edge is left; gives (old, new) of every id that merged."""
    def fn(edges: pa.Table) -> pa.Table:
        ends = [edges[c].to_numpy() for c in ("a", "b")]
        names, code = np.unique(np.concatenate(ends), return_inverse=True)
        a, b, d = code[:len(edges)], code[len(edges):], edges["d"].to_numpy()
        label = np.arange(len(names))
        while len(a):
            order = np.lexsort((b, a, d))
            a, b, d = a[order], b[order], d[order]
            rank = np.arange(len(a))
            first_a, first_b = np.full((2, len(names)), len(a))
            first_a[a[::-1]], first_b[b[::-1]] = rank[::-1], rank[::-1]
            best = np.minimum(first_a, first_b)
            mutual = (best[a] == rank) & (best[b] == rank)
            to, parts = np.arange(len(names)), np.ones(len(names), np.int64)
            to[b[mutual]], parts[a[mutual]] = a[mutual], 2
            label = to[label]
            x, y = to[a], to[b]
            stay = x != y
            key = np.minimum(x, y)[stay] * len(names) + np.maximum(x, y)[stay]
            pair, at, count = np.unique(key, return_inverse=True, return_counts=True)
            far = np.full(len(pair), -np.inf)
            np.maximum.at(far, at, d[stay])
            a, b = pair // len(names), pair % len(names)
            whole = count == parts[a] * parts[b]
            a, b, d = a[whole], b[whole], far[whole]
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pa.table([pa.array(names[moved], schema.types[0]), pa.array(names[label[moved]], schema.types[0])], schema=schema)
    return fn


def _finish_small(e: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """(merges (old, new), edges left): components of at most ``LOCAL_EDGES``
    of the ``n`` edges are merged to the end, each in one task - no edge leaves a
    component, so its rounds need no other; larger ones are left (None: none is)."""
    left, parts = None, e.withColumn("_g", F.lit(0))
    if n > LOCAL_EDGES:
        ends = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id")))
        comp = connected_components(ends, e).select(F.col("id").alias("a"), F.col("label").alias("_c"))
        named = e.join(comp, "a")
        large = F.broadcast(named.groupBy("_c").count().where(F.col("count") > LOCAL_EDGES).select("_c"))  # n / LOCAL_EDGES at most
        left = forget_size(cut_lineage(named.join(large, "_c", "left_semi").select("a", "b", "d")))
        groups = math.ceil(8 * n / LOCAL_EDGES)
        parts = named.join(large, "_c", "left_anti").withColumn("_g", F.pmod(F.xxhash64("_c"), F.lit(groups)))
    schema = T.StructType([T.StructField(c, e.schema["a"].dataType) for c in ("old", "new")])
    done = parts.select("_g", "a", "b", F.col("d").cast("double").alias("d")).groupBy("_g").applyInArrow(
        _all_rounds(to_arrow_schema(schema)), schema)
    return forget_size(cut_lineage(done)), left


def cluster_complete(vecs: DataFrame | None, t: float = 0.2, id_col: str = "id", vec: str = "vec",
                     metric: str = "cosine", edges: DataFrame | None = None,
                     classes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id, label): complete-linkage clusters cut strictly below ``t``.

    State: edges (a, b, d), a < b, between current clusters whose complete-link
    distance d is below t.  Per round every cluster picks its nearest edge by
    the total order (d, a, b); mutual picks merge (b -> a, so a label is the
    smallest id in its cluster).  Edges are re-keyed to the new labels and
    regrouped with max(d); a regrouped edge survives only if all its
    constituent edges existed (count = parts(a) * parts(b)), because a missing
    pair is at distance >= t.  Components of up to ``LOCAL_EDGES`` edges run
    their rounds in a task; the others are looked for again whenever the edges
    are halved, and go through rounds of joins in between.  ``edges`` (a, b, d) between the ids of ``vecs``,
    or ``classes`` (pairs and membership, from ``sparse.similar_classes``),
    take the place of the search.
    """
    dup, v = None, None if vecs is None else vecs.select(F.col(id_col).alias("id"))
    if edges is None:
        # identical vectors merge first at distance 0 in any merge order:
        # cluster their representatives, re-expand at the end (exact, and no
        # round per duplicate)
        edges, member = classes or knn.similar_classes(
            vecs.select(F.col(id_col).alias("id"), F.col(vec).alias("vec")), t, metric=metric)
        edges = edges.select("a", "b", F.col("dist").alias("d"))
        dup = member.select("id", F.col("rep").alias("rid"))
        v = dup.filter(F.col("id") == F.col("rid")).select("id")
    e = forget_size(cut_lineage(edges.select("a", "b", "d")))
    merges: list[DataFrame] = []
    n, looked = e.count(), None
    while n:
        if looked is None or n <= LOCAL_EDGES or 2 * n <= looked:
            done, e = _finish_small(e, n)
            merges.append(done)
            if e is None:
                break
            n = looked = e.count()
            continue
        both = (e.select(F.col("a").alias("c"), F.col("b").alias("o"), "d", "a", "b")
                .unionByName(e.select(F.col("b").alias("c"), F.col("a").alias("o"), "d", "a", "b")))
        best = both.groupBy("c").agg(F.min(F.struct("d", "a", "b")).alias("m"))
        mutual = (best.select(F.col("m.a").alias("a"), F.col("m.b").alias("b"))
                  .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
                  .filter(F.col("n") == 2).select(F.col("b").alias("old"), F.col("a").alias("new")))
        remap = forget_size(cut_lineage(mutual))
        merged = remap.select(F.col("new").alias("c")).withColumn("parts", F.lit(2))

        re = (e.alias("e")
              .join(remap.alias("_a"), F.col("e.a") == F.col("_a.old"), "left")
              .join(remap.alias("_b"), F.col("e.b") == F.col("_b.old"), "left")
              .select(F.coalesce(F.col("_a.new"), F.col("e.a")).alias("x"),
                      F.coalesce(F.col("_b.new"), F.col("e.b")).alias("y"), F.col("e.d").alias("d"))
              .filter(F.col("x") != F.col("y"))
              .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d"))
        grouped = re.groupBy("a", "b").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("cnt"))
        pa = merged.select(F.col("c").alias("a"), F.col("parts").alias("pa"))
        pb = merged.select(F.col("c").alias("b"), F.col("parts").alias("pb"))
        e = (grouped.join(pa, "a", "left").join(pb, "b", "left")
             .filter(F.col("cnt") == F.coalesce("pa", F.lit(1)) * F.coalesce("pb", F.lit(1)))
             .select("a", "b", "d"))
        e = forget_size(cut_lineage(e))
        merges.append(remap.select("old", "new"))
        n = e.count()
    members = _follow(v.select("id"), merges)
    if dup is not None:
        members = dup.join(members.select(F.col("id").alias("rid"), "label"), "rid").select("id", "label")
    return members


# ---- CLU4 / CLU5 -------------------------------------------------------------------------
def group_news(news: DataFrame, vecs: DataFrame | None, min_size: int = 1, t: float = 0.2,
               method: str = "complete", id_col: str = "id", bags: DataFrame | None = None) -> DataFrame:
    """Articles with ``group`` (cluster label) and ``is_central_news``.

    Vectors are dense (``vecs``: id, vec) or bags of words (``bags``: id, term,
    weight; methods complete and dbscan).  Centroid = mean vector per group; its
    nearest article over all given articles is central; a group whose nearest
    article lies in another group gets its own nearest member as central
    instead (no group is left without a representative).  Groups smaller than
    ``min_size`` are dropped."""
    if bags is not None:
        ids = news.select(F.col(id_col).alias("id"))
        classes = sparse.similar_classes(bags, t, inclusive=method == "dbscan", ids=ids)
        labels = (cluster_complete(None, t, classes=classes) if method == "complete"
                  else cluster_dbscan(None, t, classes=classes))
        lv = cut_lineage(labels)
        named = lv.filter(F.col("label") >= 0)
        glob = sparse.central(bags, named).select(F.col("id").alias("cid"))
        own = sparse.nearest_member(bags, named)
    else:
        v = vecs.select(F.col(id_col).alias("id"), "vec")
        if method == "complete":
            labels = cluster_complete(v, t)
        elif method == "dbscan":
            labels = cluster_dbscan(v, t)
        else:
            labels = cluster_micro(v, t)[0]
        lv = cut_lineage(v.join(labels, "id"))
        cents = knn.centroids(lv.filter(F.col("label") >= 0), "label", "vec", None)
        glob = knn.central(lv, cents, "label", "id", "vec").select(F.col("id").alias("cid"))
        own = knn.nearest_member(lv, cents, "label", "id", "vec")
    return with_central(news, lv.select("id", "label"), glob, own, min_size, id_col)


def with_central(news: DataFrame, labels: DataFrame, glob: DataFrame, own: DataFrame, min_size: int = 1,
                 id_col: str = "id") -> DataFrame:
    """Articles with their group; central are the articles ``glob`` (cid), and
    the ``own`` (label, id) of groups that have none of them."""
    has = labels.join(glob, labels["id"] == glob["cid"], "left_semi").select("label").distinct()
    fallback = own.join(has, "label", "left_anti").select(F.col("id").alias("cid"))
    centrals = glob.unionByName(fallback).distinct()
    lab = labels.select(F.col("id").alias("_gid"), F.col("label").alias("group"))
    out = (news.join(lab, news[id_col] == F.col("_gid"))
           .join(centrals, F.col("_gid") == F.col("cid"), "left")
           .withColumn("is_central_news", F.col("cid").isNotNull()).drop("cid", "_gid"))
    return min_group_size(out, "group", min_size) if min_size > 1 else out


def trends(news: DataFrame, vecs: DataFrame, min_size: int = 1, **kw) -> DataFrame:
    """CLU5 (plain): the grouped articles."""
    return group_news(news, vecs, min_size, **kw)


def personalised_trends(grouped: DataFrame, codes: DataFrame, user_codes, min_rate: float = 0.5) -> DataFrame:
    """CLU5: keep groups where the share of articles whose codes (or their
    level-1 prefixes) meet the user's codes is at least ``min_rate``.

    codes: bridge (news_id, okved); user_codes: list or DataFrame (okved).
    Fully relational: code rows are matched by a semi join, never collected."""
    from ..functions.scalars import code_prefix
    if isinstance(user_codes, (list, tuple)):
        user_codes = grouped.sparkSession.createDataFrame([(c,) for c in user_codes], "okved string")
    cand = codes.select("news_id", F.explode(F.array(F.col("okved"), code_prefix("okved", 1))).alias("_c"))
    user = user_codes.select(F.col("okved").alias("_c")).distinct()
    matched = cand.join(user, "_c", "left_semi").select(F.col("news_id").alias("_mid")).distinct()
    flags = (grouped.select("id", "group").join(matched, F.col("id") == F.col("_mid"), "left")
             .select("group", F.col("_mid").isNotNull().alias("m")))
    keep = match_rate(flags, "group", "m", min_rate).select("group")
    return grouped.join(keep, "group", "left_semi")
