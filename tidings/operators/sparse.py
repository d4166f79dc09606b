"""Sparse unit vectors as rows (id, term, weight): bags of words that lose no
word, and exact similarity joins over an inverted index.

Prefix filter with norm bounds (L2AP, Anastasiu and Karypis 2014).  All vectors
order their terms alike, the rarest first.  If two unit vectors have a dot
product of ``least`` or more, their rarest common term stands in both before
the rest of either is shorter than ``least``: what follows it cannot make up
the product.  Only these prefixes are indexed, so frequent words mostly
are not.  Two postings of a term are a candidate if the term's own product
plus the product of what is left of both can reach ``least``; candidates are
verified on whole vectors, block by block.  Equal vectors are one.  Nothing is copied to
cells and no vector is dense; a term with many postings is cut on both sides
into bounded blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import clean_tokens
from ..session import cut_lineage
from .skew import join_counted

#: Postings of one term that meet in one group, on either side.
BLOCK_POSTINGS = 1024
#: Candidates and terms of a pair of blocks that are verified in one group.
GROUP_PAIRS, GROUP_TERMS = 1 << 20, 1 << 21
#: Terms of candidates that a task holds at once.
CHUNK_TERMS = 1 << 20
#: Rounding of products of unit vectors.
_SLACK = 1e-9


# VEC1 / VEC2 -------------------------------------------------------------------------
def bag_vectors(df: DataFrame, text_col: str, id_col: str = "id") -> DataFrame:
    """(id, term, weight): counts of the cleaned tokens, scaled to unit length;
    a text without tokens has no rows."""
    counts = (df.select(F.col(id_col).alias("id"), F.explode(clean_tokens(text_col)).alias("term"))
              .groupBy("id", "term").agg(F.count(F.lit(1)).alias("_n")))
    norm = F.sqrt(F.sum(F.col("_n") * F.col("_n")).over(Window.partitionBy("id")))
    return counts.select("id", "term", (F.col("_n") / norm).alias("weight"))


def bags(rows: DataFrame) -> DataFrame:
    """(id, bag): a vector's terms and weights as one array, by term."""
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("bag"))


# the join ----------------------------------------------------------------------------
def prefixes(rows: DataFrame, freq: DataFrame, least: float, total: int) -> DataFrame:
    """The indexed part of every vector: (id, term, weight, after) with the
    length of what follows the term, in the order of ``freq`` (term, df)."""
    ranked = join_counted(rows, freq, "term", "df", total)
    before = Window.partitionBy("id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    square = F.col("weight") * F.col("weight")
    ranked = ranked.withColumn("_before", F.coalesce(F.sum(square).over(before), F.lit(0.0)))
    return ranked.where(F.col("_before") <= 1.0 - least * least + _SLACK).select(
        "id", "term", "weight", F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("_before") - square)).alias("after"))


def candidate_pairs(left: DataFrame, right: DataFrame | None, least: float,
                    block: int = BLOCK_POSTINGS) -> DataFrame:
    """(a, b) of left and right vectors whose dot product may be ``least`` or
    more; ``right`` None: pairs a < b of the left ones."""
    both = left if right is None else left.unionByName(right)
    freq = cut_lineage(both.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    total = freq.agg(F.sum("df")).first()[0] or 0
    lo = cut_lineage(prefixes(left, freq, least, total))
    hi = lo if right is None else cut_lineage(prefixes(right, freq, least, total))

    def parts(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("term").agg(F.count(F.lit(1)).alias(name))
    n = parts(lo, "_ln").join(parts(hi, "_rn"), "term")
    if right is None:
        n = n.where("_ln > 1")  # a term of one vector has no pair
    n = cut_lineage(n.withColumns({"_lp": F.ceil(F.col("_ln") / block), "_rp": F.ceil(F.col("_rn") / block)}))
    sums = n.agg(F.sum("_ln").alias("l"), F.sum("_rn").alias("r")).first()
    own = lambda c: F.pmod(F.xxhash64("id", F.lit(5)), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    keys = ["term", "_i", "_j"]
    x = join_counted(lo, n, "term", "_ln", sums["l"] or 0).withColumn("_i", own("_lp")).withColumn("_j", every("_rp")).select(
        *keys, F.col("id").alias("a"), F.col("weight").alias("_aw"), F.col("after").alias("_aa"))
    y = join_counted(hi, n, "term", "_rn", sums["r"] or 0).withColumn("_j", own("_rp")).withColumn("_i", every("_lp")).select(
        *keys, F.col("id").alias("b"), F.col("weight").alias("_bw"), F.col("after").alias("_ba"))
    reach = F.col("_aw") * F.col("_bw") + F.col("_aa") * F.col("_ba") >= least - _SLACK
    met = x.join(y, keys).where(reach if right is not None else reach & (F.col("a") < F.col("b")))
    return met.select("a", "b").distinct()


def _dots(least: float, schema: pa.Schema):
    """Kernel of a block pair: ``left`` rows (a, partners, terms, weights) against
    ``right`` rows (b, terms, weights); a left vector is spread out over the
    block's terms once and all its partners are read off it, their common terms
    added up in the terms' own order."""
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        partners = left["_b"].combine_chunks()
        at = pc.index_in(partners.flatten(), value_set=right["b"].combine_chunks())
        at = np.asarray(pc.fill_null(at, -1))
        words = right["_terms"].combine_chunks()
        coded = words.flatten().dictionary_encode()
        code, weight = np.asarray(coded.indices), np.asarray(right["_weights"].combine_chunks().flatten())
        size = np.asarray(pc.list_value_length(words)).astype(np.int64)
        first = np.cumsum(size) - size
        asked = left["_terms"].combine_chunks()
        own = np.asarray(pc.fill_null(pc.index_in(asked.flatten(), value_set=coded.dictionary), -1))
        own_weight = np.asarray(left["_weights"].combine_chunks().flatten())
        ends = [np.cumsum(np.asarray(pc.list_value_length(c)).astype(np.int64)) for c in (partners, asked)]
        spread = np.zeros(len(coded.dictionary) + 1)  # the last place takes what the block does not know
        rows, others, dots = [], [], []
        for r in range(len(left)):
            mine = at[ends[0][r - 1] if r else 0:ends[0][r]]
            mine = mine[mine >= 0]
            terms = slice(ends[1][r - 1] if r else 0, ends[1][r])
            spread[own[terms]] = own_weight[terms]
            spread[-1] = 0.0
            # so many partners at once that their terms stay within a bound
            for some in np.split(mine, np.flatnonzero(np.diff(np.cumsum(size[mine]) // CHUNK_TERMS)) + 1):
                n = size[some]
                seg = np.repeat(np.arange(len(some)), n)
                entry = np.arange(len(seg)) + np.repeat(first[some] - (np.cumsum(n) - n), n)
                dot = np.bincount(seg, weights=spread[code[entry]] * weight[entry], minlength=len(some))
                keep = np.flatnonzero(dot >= least - _SLACK)
                rows.append(np.full(len(keep), r))
                others.append(some[keep])
                dots.append(dot[keep])
            spread[own[terms]] = 0.0
        none = np.zeros(0, np.int64)
        return pa.table([left["a"].take(pa.array(np.concatenate([none, *rows]))),
                         right["b"].take(pa.array(np.concatenate([none, *others]))),
                         pa.array(np.concatenate([np.zeros(0), *dots]))], schema=schema)
    return fn


def pairs_above(left: DataFrame, right: DataFrame | None, least: float, block: int = BLOCK_POSTINGS) -> DataFrame:
    """(a, b, dot): the candidates with their dot products, those below ``least`` left out.

    Both sides are dealt to blocks; a vector is sent once to every block in which
    it has a candidate, not once per candidate.  Blocks are as many as keep the
    candidates and the terms of a pair of blocks about ``GROUP_PAIRS`` and ``GROUP_TERMS``."""
    found = cut_lineage(candidate_pairs(left, right, least, block))
    other = left if right is None else right
    terms = max(side.count() for side in ((left,) if right is None else (left, right)))
    blocks = max(1, math.ceil(math.sqrt(found.count() / GROUP_PAIRS)), math.ceil(terms / GROUP_TERMS))
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(blocks))

    def whole(rows: DataFrame, side: str) -> DataFrame:
        return bags(rows).select(F.col("id").alias(side), F.col("bag.term").alias("_terms"), F.col("bag.weight").alias("_weights"))
    lists = (found.groupBy("a", place("b").alias("_j")).agg(F.collect_list("b").alias("_b"))
             .join(whole(left, "a"), "a").withColumn("_i", place("a")))
    known = (found.select("b", place("a").alias("_ki")).distinct().join(whole(other, "b"), "b").withColumn("_kj", place("b")))
    types = [("a", left.schema["id"].dataType), ("b", other.schema["id"].dataType), ("dot", T.DoubleType())]
    schema = T.StructType([T.StructField(n, t) for n, t in types])
    return (lists.groupBy("_i", "_j").cogroup(known.groupBy("_ki", "_kj"))
            .applyInArrow(_dots(least, to_arrow_schema(schema)), schema))


# JN14 --------------------------------------------------------------------------------
def collapse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal vectors as one: (rows of the representatives, membership (id, rep)).
    Grouped by a hash; a vector that differs from its group's representative
    (a hash collision) stands for itself."""
    whole = cut_lineage(bags(rows).withColumn("_h", F.xxhash64("bag")))
    first = whole.groupBy("_h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("_n"))
    first = first.join(whole.select(F.col("id").alias("rep"), F.col("bag").alias("_bag")), "rep")
    member = cut_lineage(join_counted(whole, first, "_h", "_n", whole.count()).select(
        "id", F.when(F.col("bag") == F.col("_bag"), F.col("rep")).otherwise(F.col("id")).alias("rep")))
    return cut_lineage(rows.join(member.where("id = rep").select("id"), "id", "left_semi")), member


def similar_classes(rows: DataFrame, t: float, inclusive: bool = False, ids: DataFrame | None = None,
                    block: int = BLOCK_POSTINGS) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b, dist) with cosine distance below ``t`` (``inclusive``: at
    most) between representatives of equal vectors, and the membership (id,
    rep).  ``ids`` names all articles: those without a term stand alone."""
    if not 0 <= t <= 1:
        raise ValueError("cosine cuts lie between 0 and 1")
    reps, member = collapse(rows)
    dist = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("dot"))
    pairs = pairs_above(reps, None, 1.0 - t, block).select("a", "b", dist.alias("dist"))
    pairs = pairs.where(F.col("dist") <= t if inclusive else F.col("dist") < t)
    if ids is not None:
        member = member.unionByName(ids.select("id").join(member, "id", "left_anti").select("id", F.col("id").alias("rep")))
    return pairs, member


def similar_pairs(rows: DataFrame, t: float, inclusive: bool = False, block: int = BLOCK_POSTINGS) -> DataFrame:
    """All pairs (a < b, dist) of articles below ``t``, copies one by one."""
    pairs, member = similar_classes(rows, t, inclusive, block=block)
    ma = member.select(F.col("id").alias("x"), F.col("rep").alias("a"))
    mb = member.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    far = pairs.join(ma, "a").join(mb, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dist")
    if not (t > 0 or inclusive):
        return far
    same = ma.join(mb, ma["a"] == mb["b"]).where("x < y").select(
        F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0.0).alias("dist"))
    return far.unionByName(same)


# FLT7 / VEC5 ---------------------------------------------------------------------------
def near_rows(queries: DataFrame, data: DataFrame, k: int, max_sq: float, block: int = BLOCK_POSTINGS) -> DataFrame:
    """(id, nid, dist, rank): the ``k`` nearest vectors of every query with a
    squared L2 distance below ``max_sq`` (at most 2), ties by id.

    Equal vectors are searched once; of a class only its ``k`` smallest ids
    can be among the nearest."""
    if not 0 <= max_sq <= 2:
        raise ValueError("squared distances of these vectors lie between 0 and 2")
    asked, of_query = collapse(queries)
    known, of_data = collapse(data)
    first = Window.partitionBy("rep").orderBy("id")
    some = of_data.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).select(
        F.col("rep").alias("b"), F.col("id").alias("nid"))
    dist = F.greatest(F.lit(0.0), F.lit(2.0) - 2.0 * F.col("dot"))
    met = pairs_above(asked, known, 1.0 - max_sq / 2.0, block).select("a", "b", dist.alias("dist")).where(
        F.col("dist") < max_sq)
    best = Window.partitionBy("a").orderBy("dist", "nid")
    ranked = met.join(some, "b").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return of_query.select("id", F.col("rep").alias("a")).join(ranked, "a").select("id", "nid", "dist", "rank")


def _score(dot: str) -> Column:
    """Squared distance of a unit vector to a mean, but for the mean's own
    square; two members are equally far from theirs, so rounding must not decide."""
    return F.round(1.0 - 2.0 * F.col(dot), 12)


# AGG4 / RNK8 -----------------------------------------------------------------------------
def centroids(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, term, weight): the mean vector of every label's articles; an
    article without a term counts."""
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    sums = rows.join(labels, "id").groupBy("label", "term").agg(F.sum("weight").alias("_s"))
    return sums.join(size, "label").select("label", "term", (F.col("_s") / F.col("_n")).alias("weight"))


def central(rows: DataFrame, labels: DataFrame, block: int = BLOCK_POSTINGS) -> DataFrame:
    """(label, id): the article nearest to each label's mean, over all articles
    (ties to the smaller id).

    The best member bounds the search: another article must have a greater
    product with the mean, so it shares a term of the mean's prefix whose rest is
    as long as that product."""
    rows, labels = cut_lineage(rows), cut_lineage(labels)
    mean = cut_lineage(centroids(rows, labels))
    own = (rows.join(labels, "id").join(mean.withColumnRenamed("weight", "_c"), ["label", "term"])
           .groupBy("label", "id").agg(F.sum(F.col("weight") * F.col("_c")).alias("dot")))
    floor = cut_lineage(own.groupBy("label").agg(F.max("dot").alias("floor")))
    freq = cut_lineage(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    square = F.col("weight") * F.col("weight")
    # summed from the end: a frame up to the last row is added up anew for every row
    ordered = Window.partitionBy("label").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = cut_lineage(mean.join(freq, "term").withColumn("_rest", F.sqrt(F.sum(square).over(ordered))).join(floor, "label")
                        .where(F.col("_rest") >= F.col("floor") - _SLACK))
    n = cut_lineage(asked.groupBy("term").agg(F.count(F.lit(1)).alias("_ln")).join(freq, "term").withColumns(
        {"_lp": F.ceil(F.col("_ln") / block), "_rp": F.ceil(F.col("df") / block)}))
    sums = n.agg(F.sum("_ln").alias("l"), F.sum("df").alias("r")).first()
    keys = ["term", "_i", "_j"]
    x = join_counted(asked.select("label", "term"), n, "term", "_ln", sums["l"] or 0).withColumn(
        "_i", F.pmod(F.xxhash64("label"), F.col("_lp"))).withColumn(
        "_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rp") - 1))).select(*keys, "label")
    y = join_counted(rows.select("id", "term"), n, "term", "df", sums["r"] or 0).withColumn(
        "_j", F.pmod(F.xxhash64("id"), F.col("_rp"))).withColumn(
        "_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lp") - 1))).select(*keys, "id")
    met = x.join(y, keys).select("label", "id").distinct()
    scored = (met.join(rows, "id").join(mean.withColumnRenamed("weight", "_c"), ["label", "term"])
              .groupBy("label", "id").agg(F.sum(F.col("weight") * F.col("_c")).alias("dot")))
    # |x - c|^2 = |x|^2 - 2 x.c + |c|^2, with |x| = 1, or 0 without a term
    empty = labels.join(rows.select("id").distinct(), "id", "left_anti")
    nothing = empty.agg(F.min("id").alias("id")).scalar()  # one value
    score = lambda s, i: F.struct(s.alias("s"), i.alias("id")).alias("m")
    best = scored.select("label", score(_score("dot"), F.col("id"))).unionByName(
        labels.select("label").distinct().select("label", score(F.lit(0.0), nothing)).where("m.id is not null"))
    return best.groupBy("label").agg(F.min("m").alias("m")).select("label", F.col("m.id").alias("id"))


def nearest_member(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, id): the member nearest to its own label's mean."""
    mean = centroids(rows, labels).withColumnRenamed("weight", "_c")
    dots = (rows.join(labels, "id").join(mean, ["label", "term"])
            .groupBy("label", "id").agg(F.sum(F.col("weight") * F.col("_c")).alias("dot")).select("label", "id", _score("dot").alias("s")))
    every = labels.join(dots, ["label", "id"], "left")
    return every.groupBy("label").agg(F.min(F.struct(F.coalesce("s", F.lit(0.0)).alias("s"), F.col("id"))).alias("m")).select(
        "label", F.col("m.id").alias("id"))
