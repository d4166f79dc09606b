"""Text mining at scale (AGG8-10, AGG13-14, RNK7, RNK9, TXT1-10, VEC1-2).

Documents are token arrays ``(doc_id, tokens)``; every statistic is an
explode + groupBy (partial aggregation, no per-document Python); words and
pairs of words are counted slice by slice with Arrow and then added up.  Models come
from Spark ML (HashingTF, CountVectorizer, LDA); word vectors are learnt in
blocks (``skipgram``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_tokens, l2_normalize
from ..functions.wordlists import TOPIC_NAMES
from ..session import stage_table
from . import skipgram

#: Tokens of the documents that meet their words' vectors in one group.
BLOCK_TOKENS = 1 << 20
#: Tokens of the documents from which word vectors are learnt together, and
#: vectors that are averaged in one group.
SKIPGRAM_TOKENS, SKIPGRAM_WORDS = 1 << 21, 1 << 18
#: Tokens that a task counts, or joins to phrases, at once.
COUNT_TOKENS = 1 << 21
#: A phrase table of at most so many pairs and bytes is taken along by the documents' tasks.
SMALL_PHRASES, SMALL_PHRASE_BYTES = 1 << 18, 1 << 24


def token_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens) with FN3-FN5 cleaning."""
    return docs.select(F.col(id_col).alias("doc_id"), clean_tokens(text_col).alias("tokens"))


def token_rows(td: DataFrame) -> DataFrame:
    """Long form (doc_id, pos, token)."""
    return td.select("doc_id", F.posexplode("tokens").alias("pos", "token"))


def _token_pieces(batches, most: int):
    """Slices of Arrow batches with about ``most`` tokens, whole rows: the slice, the
    tokens in one array and the rows' number of tokens."""
    for batch in batches:
        tokens = batch.column("tokens")
        size = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
        piece = (np.cumsum(size) - size) // most
        cuts = [0, *(np.nonzero(np.diff(piece))[0] + 1).tolist(), len(size)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(i, j - i)
            yield part, part.column("tokens").flatten(), size[i:j]


def _count_piece(batches):
    """Rows (pair, a, b, n): the words ``a`` and the pairs of words of one slice."""
    for _, flat, size in _token_pieces(batches, COUNT_TOKENS):
        if not len(flat):
            continue
        coded = flat.dictionary_encode("encode")
        names, code = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        last = np.zeros(len(code), bool)
        last[np.cumsum(size)[size > 0] - 1] = True
        pairs, n_ab = np.unique((code[:-1] * len(names) + code[1:])[~last[:-1]], return_counts=True)
        words = np.arange(len(names))
        none = pa.nulls(len(names), pa.string())
        for pair, a, b, n in ((False, words, none, np.bincount(code, minlength=len(names))),
                              (True, pairs // len(names), names.take(pa.array(pairs % len(names))), n_ab)):
            found = pa.table({"pair": pa.array(np.full(len(a), pair)), "a": names.take(pa.array(a)), "b": b,
                              "n": pa.array(n, pa.int64())})
            yield from found.to_batches(max_chunksize=1 << 16)


def _distinct_in_piece(batches):
    for _, flat, _ in _token_pieces(batches, COUNT_TOKENS):
        yield from pa.table({"word": pc.unique(flat)}).to_batches(max_chunksize=1 << 16)


def distinct_words(td: DataFrame) -> DataFrame:
    """(word): every token once; tasks drop repeats before anything is a row."""
    return td.select("tokens").mapInArrow(_distinct_in_piece, "word string").distinct()


# AGG8 / TXT5 ----------------------------------------------------------------------
def doc_freq(td: DataFrame) -> DataFrame:
    """(term, df): number of documents containing the term."""
    return (td.select(F.explode(F.array_distinct("tokens")).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def filter_extremes(dfreq: DataFrame, n_docs, no_below: int = 5, no_above: float = 0.5,
                    keep_n: int | None = None) -> DataFrame:
    """Keep terms with df >= no_below and df / N <= no_above; optionally the
    keep_n most frequent (ties by term), via a bounded top-k."""
    kept = dfreq.filter((F.col("df") >= no_below) & (F.col("df") / F.lit(n_docs) <= no_above))
    if keep_n is not None:
        kept = kept.orderBy(F.desc("df"), F.asc("term")).limit(keep_n)
    return kept


def dictionary(kept_terms: DataFrame) -> DataFrame:
    """(term, term_id) with ids 0..V-1 in term order (no single-task window)."""
    from ..functions.clean import with_dense_id
    return with_dense_id(kept_terms.select("term"), ["term"], "term_id")


# AGG9 ------------------------------------------------------------------------------
def doc2bow(td: DataFrame, dictionary_df: DataFrame) -> DataFrame:
    """(doc_id, term_id, cnt) restricted to the dictionary."""
    counts = (td.select("doc_id", F.explode("tokens").alias("term"))
              .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("cnt")))
    return counts.join(dictionary_df, "term").select("doc_id", "term_id", "term", "cnt")


# AGG10 -----------------------------------------------------------------------------
def corpus_stats(td: DataFrame) -> DataFrame:
    """documents, token positions, unique tokens and (doc, term) non-zeros,
    as one row (the two distinct counts are scalar subqueries)."""
    ex = td.select("doc_id", F.explode("tokens").alias("t"))
    uniq = ex.select(F.countDistinct("t")).scalar()
    nnz = ex.select(F.countDistinct("doc_id", "t")).scalar()
    return td.agg(F.count(F.lit(1)).alias("n_docs"),
                  F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("n_positions")).select(
        "n_docs", "n_positions", uniq.alias("n_unique"), nnz.alias("n_nonzero"))


# TXT1 ------------------------------------------------------------------------------
def bigrams(td: DataFrame) -> DataFrame:
    """(doc_id, pos, a, b) for consecutive token pairs."""
    n = F.size("tokens")
    pairs = F.arrays_zip(F.slice("tokens", 1, F.greatest(n - 1, F.lit(0))).alias("a"),
                         F.slice("tokens", 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    return td.select("doc_id", F.posexplode(pairs).alias("pos", "p")).select(
        "doc_id", "pos", F.col("p.a").alias("a"), F.col("p.b").alias("b"))


def fit_phrases(td: DataFrame, min_count: int = 20, threshold: float = 10.0) -> DataFrame:
    """Phrase model: (a, b, phrase, score) for pairs with
    score = (n_ab - min_count) / (n_a * n_b) * |vocab| > threshold,
    where |vocab| counts distinct unigrams and bigrams (Mikolov et al. 2013).

    Words and pairs are counted in slices of documents and added up; only counts
    above ``min_count`` can score, the others are counted for |vocab| while the
    sums are written and go no further."""
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    seen = Observation()
    counts = (td.select("tokens").mapInArrow(_count_piece, "pair boolean, a string, b string, n long")
              .groupBy("pair", "a", "b").agg(F.sum("n").alias("n")))
    kept = stage_table(counts.observe(seen, F.count_if(~F.col("pair")).alias("words"), F.count_if("pair").alias("pairs"))
                       .where(F.col("n") > min_count), "phrase-counts")
    n_uni, n_bi = seen.get["words"], seen.get["pairs"]
    uni = kept.where("not pair").select(F.col("a").alias("w"), "n")
    bi = kept.where("pair").select("a", "b", F.col("n").alias("n_ab"))
    ua = uni.select(F.col("w").alias("a"), F.col("n").alias("n_a"))
    ub = uni.select(F.col("w").alias("b"), F.col("n").alias("n_b"))
    scored = (bi.join(ua, "a").join(ub, "b").withColumn(
        "score", (F.col("n_ab") - F.lit(float(min_count))) / (F.col("n_a") * F.col("n_b")) * F.lit(n_uni + n_bi)))
    return (scored.filter(F.col("score") > threshold)
            .select("a", "b", F.concat("a", F.lit("_"), "b").alias("phrase"), "score", "n_ab"))


# TXT2 ------------------------------------------------------------------------------
def _phrase_kernel(phrases: pa.Table, mode: str):
    """Joins the pairs of ``phrases`` in batches of documents; one without an id
    keeps its tokens, as no join finds it."""
    phrases = phrases.drop_null()
    first, second = (phrases[c].combine_chunks() for c in ("a", "b"))
    names = pc.unique(pa.concat_arrays([first, second]))
    known = np.sort(np.asarray(pc.index_in(first, names)).astype(np.int64) * len(names)
                    + np.asarray(pc.index_in(second, names)))

    def run(batches):
        for part, flat, size in _token_pieces(batches, COUNT_TOKENS):
            code = np.asarray(pc.fill_null(pc.index_in(flat, value_set=names), -1)).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            has_id = np.asarray(part.column("doc_id").is_valid())
            fits = (code[:-1] >= 0) & (code[1:] >= 0) & (row[:-1] == row[1:]) & has_id[row[:-1]]
            at = np.nonzero(fits)[0]
            key = code[at] * len(names) + code[at + 1]
            place = np.searchsorted(known, key)
            at = at[(place < len(known)) & (known[np.minimum(place, len(known) - 1)] == key)] if len(known) else at[:0]
            start = np.ones(len(at), bool)
            start[1:] = np.diff(at) > 1
            at = at[(at - at[start][np.cumsum(start) - 1]) % 2 == 0] if len(at) else at
            joined = pc.binary_join_element_wise(flat.take(pa.array(at)), flat.take(pa.array(at + 1)), "_")
            if mode == "append":
                order = np.argsort(np.concatenate([row, row[at]]), kind="stable")
                n = size + np.bincount(row[at], minlength=len(size))
            else:
                order = np.arange(len(flat))
                order[at] = len(flat) + np.arange(len(at))
                order = np.delete(order, at + 1)
                n = size - np.bincount(row[at], minlength=len(size))
            values = pa.concat_arrays([flat, joined]).take(pa.array(order))
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            tokens = pa.ListArray.from_arrays(offsets, values, mask=part.column("tokens").is_null())
            yield pa.record_batch({"doc_id": part.column("doc_id"), "tokens": tokens})
    return run


def apply_phrases(td: DataFrame, phrases: DataFrame, mode: str = "replace") -> DataFrame:
    """Greedy left-to-right phrase joining (a pair is joined unless its first
    token was already consumed by the previous phrase).

    In a run of consecutive candidates every second one is taken.  A phrase table of
    a few megabytes (``SMALL_PHRASES``, ``SMALL_PHRASE_BYTES``) is taken along by the
    documents' tasks.  For a larger one candidate positions come from a join
    with it (run start found with a window over the candidates of one
    document); the taken positions go back to the document as one array and its
    tokens are cut at them, so tokens are shuffled once, as arrays.  mode
    'append' keeps the original tokens and appends the phrase tokens."""
    if mode not in ("replace", "append"):
        raise ValueError("mode must be 'replace' or 'append'")
    ph = phrases.select("a", "b").distinct()
    few = ph.limit(SMALL_PHRASES + 1).toArrow()
    if len(few) <= SMALL_PHRASES and few.nbytes <= SMALL_PHRASE_BYTES:
        td = td.select("doc_id", "tokens")
        return td.mapInArrow(_phrase_kernel(few, mode), td.schema)
    cand = bigrams(td).join(ph, ["a", "b"], "left_semi").select("doc_id", "pos")
    w = Window.partitionBy("doc_id").orderBy("pos")
    runs = (cand.withColumn("_start", F.when(F.lag("pos").over(w) == F.col("pos") - 1, F.lit(None))
                            .otherwise(F.col("pos")))
            .withColumn("_start", F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    taken = (runs.filter((F.col("pos") - F.col("_start")) % 2 == 0)
             .groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("_at")))
    res = td.join(taken, "doc_id", "left").withColumn("_at", F.coalesce("_at", F.array().cast("array<int>")))
    begin = lambda i: F.when(i == 0, 0).otherwise(F.element_at("_at", F.greatest(i, F.lit(1))) + 2)
    joined = lambda p: F.concat(F.element_at("tokens", p + 1), F.lit("_"), F.element_at("tokens", p + 2))
    cut = F.flatten(F.transform("_at", lambda p, i: F.concat(
        F.slice("tokens", begin(i) + 1, p - begin(i)), F.array(joined(p)))))
    end = begin(F.size("_at"))
    phrased = F.when(F.size("_at") == 0, F.col("tokens")).otherwise(
        F.concat(cut, F.slice("tokens", end + 1, F.greatest(F.size("tokens") - end, F.lit(0)))))
    if mode == "replace":
        return res.select("doc_id", phrased.alias("tokens"))
    return res.select("doc_id", F.concat("tokens", F.transform("_at", joined)).alias("tokens"))


# TXT3 ------------------------------------------------------------------------------
def fit_word2vec(td: DataFrame, size: int = 100, window: int = 5, min_count: int = 1, seed: int = 42,
                 max_iter: int = 1, block_tokens: int | None = None):
    """Skip-gram word vectors (``skipgram``); returns (vocabulary (word, n),
    word_vectors (word, vec array<float>)), both staged.

    Documents are learnt in blocks of about ``block_tokens`` tokens, each with the
    vectors of its own words, which are averaged after each of the ``max_iter``
    passes; neither words nor vectors pass the driver."""
    seen = Observation()
    rows = stage_table(td.select(F.monotonically_increasing_id().alias("row"), "tokens").observe(
        seen, F.sum(F.coalesce(F.size("tokens"), F.lit(0))).alias("n")), "word2vec-rows")
    blocks = max(1, -(-(seen.get["n"] or 0) // (block_tokens or SKIPGRAM_TOKENS)))
    docs = rows.where(F.size("tokens") > 0).select(
        F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("_b"), "row", "tokens")
    here = stage_table(docs.select("_b", F.explode("tokens").alias("word")).where("word is not null")
                       .groupBy("_b", "word").agg(F.count(F.lit(1)).alias("here")), "word2vec-counts")
    found = Observation()
    vocabulary = stage_table(here.groupBy("word").agg(F.sum("here").alias("n")).where(F.col("n") >= min_count)
                             .observe(found, F.count(F.lit(1)).alias("n")), "word2vec-vocabulary")
    if not found.get["n"]:
        raise ValueError("no word occurs min_count times")
    words = here.join(vocabulary, "word").withColumn("seed", F.xxhash64(F.lit(seed), "word"))
    groups = max(1, -(-here.count() // SKIPGRAM_WORDS))
    schema = "word string, here long, vec array<float>"
    learnt = None
    for i in range(max_iter):
        known = (words.withColumn("vec", F.lit(None).cast("array<float>")) if learnt is None
                 else words.join(learnt.select("word", "vec"), "word")).withColumnRenamed("_b", "_wb")
        learn = skipgram.learn_block(size, window, seed + i, i == max_iter - 1)
        parts = docs.groupBy("_b").cogroup(known.groupBy("_wb")).applyInArrow(learn, schema)
        learnt = stage_table(parts.groupBy(F.pmod(F.xxhash64("word"), F.lit(groups)).alias("_g"))
                             .applyInArrow(skipgram.average, schema), "word2vec-vectors")
    return vocabulary, learnt.select("word", "vec")


# AGG13 -----------------------------------------------------------------------------
def _with_vectors(td: DataFrame, word_vectors: DataFrame, stats: list[Column], kernel, schema: str,
                  block_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The staged rows of ``td``, and ``kernel(counts, words)`` over blocks of
    documents of about ``block_tokens`` tokens.  ``counts`` has a row per document
    and distinct token, with ``stats``; ``words`` the vectors of the block's
    distinct words, so a vector travels once per (block, word) and not once per
    (document, word).  Rows of one doc_id share a block; those without one are
    left out, as no id equals theirs."""
    seen = Observation()
    rows = stage_table(td.select("doc_id", "tokens").observe(
        seen, F.sum(F.coalesce(F.size("tokens"), F.lit(0))).alias("n")), "token-blocks")
    blocks = max(1, -(-(seen.get["n"] or 0) // (block_tokens or BLOCK_TOKENS)))
    docs = rows.where("doc_id is not null").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("_b"), "doc_id", "tokens")
    # tokens are shuffled once, as arrays, and counted where they arrive
    counts = (docs.repartition("_b").select("_b", "doc_id", F.posexplode("tokens").alias("pos", "token"))
              .groupBy("_b", "doc_id", "token").agg(*stats))
    words = docs.select("_b", F.explode("tokens").alias("word")).distinct()
    known = words.join(word_vectors.select("word", "vec"), "word").select(F.col("_b").alias("_wb"), "word", "vec")
    return rows, counts.groupBy("_b").cogroup(known.groupBy("_wb")).applyInArrow(kernel, schema)


class _Block:
    """The known tokens of a block by document: of each document in ``ids`` the
    ``start`` and ``end`` in ``entry`` (row of the counts) and ``word`` (row of the
    words).  A word with several vectors is there with each."""

    def __init__(self, counts: pa.Table, words: pa.Table):
        coded = counts["doc_id"].combine_chunks().dictionary_encode()
        self.ids, doc = coded.dictionary, np.asarray(coded.indices)
        names = pc.unique(words["word"].combine_chunks())
        code = np.asarray(pc.fill_null(pc.index_in(counts["token"].combine_chunks(), value_set=names, skip_nulls=True), -1))
        entry = np.nonzero(code >= 0)[0]
        entry = entry[np.argsort(doc[entry], kind="stable")]
        of_word = np.asarray(pc.index_in(words["word"].combine_chunks(), value_set=names))
        by_word, copies = np.argsort(of_word, kind="stable"), np.bincount(of_word, minlength=len(names))
        first, each = np.cumsum(copies) - copies, copies[code[entry]]
        self.entry = np.repeat(entry, each)
        nth = np.arange(len(self.entry)) - np.repeat(np.cumsum(each) - each, each)
        self.word = by_word[first[code[self.entry]] + nth]
        self.start, self.end = (np.searchsorted(doc[self.entry], np.arange(len(self.ids)), side) for side in ("left", "right"))
        vecs = words["vec"].combine_chunks()
        self.there = np.asarray(vecs.is_valid())
        flat = vecs.drop_null().flatten().to_numpy(zero_copy_only=False)
        self.x = np.zeros((len(vecs), len(flat) // max(1, int(self.there.sum()))), flat.dtype)
        self.x[self.there] = flat.reshape(int(self.there.sum()), self.x.shape[1])
        self.n = counts["n"].to_numpy()

    def documents(self):
        """Per document with known tokens: its number, its slice, the tokens' unit
        vectors (a zero or null vector is zero) and their counts."""
        for d in np.nonzero(self.end > self.start)[0]:
            at = slice(self.start[d], self.end[d])
            u = self.x[self.word[at]].astype(np.float64)
            norm = np.sqrt(np.cumsum(u * u, axis=1)[:, -1:])  # added up in order, as l2_norm does
            yield d, at, u / np.where(norm == 0, 1.0, norm), self.n[self.entry[at]]


def doc_vector(td: DataFrame, word_vectors: DataFrame, dims: int, block_tokens: int | None = None) -> DataFrame:
    """Mean of unit word vectors over in-vocabulary tokens (every occurrence,
    joined once per block and distinct word); the zero vector when none is known.
    Null vectors count and add nothing; a mean of them alone has null elements."""
    def kernel(counts: pa.Table, words: pa.Table) -> pa.Table:
        block = _Block(counts, words)
        found, mean, empty = [], [], []
        for d, at, u, n in block.documents():
            found.append(d)
            mean.append((u[:, :dims] * n[:, None]).sum(axis=0) / n.sum() if u.shape[1] else np.zeros(dims))
            empty.append(not block.there[block.word[at]].any())
        flat = pa.array(np.concatenate([np.zeros(0), *mean]), mask=np.repeat(np.array(empty, bool), dims))
        offsets = pa.array(np.arange(len(found) + 1) * dims, pa.int32())
        return pa.table({"doc_id": block.ids.take(pa.array(found, pa.int64())),
                         "dvec": pa.ListArray.from_arrays(offsets, flat)})
    schema = f"doc_id {td.schema['doc_id'].dataType.simpleString()}, dvec array<double>"
    rows, means = _with_vectors(td, word_vectors, [F.count(F.lit(1)).alias("n")], kernel, schema, block_tokens)
    zero = F.array_repeat(F.lit(0.0).cast("double"), dims)
    return rows.select("doc_id").join(means, "doc_id", "left").withColumn("dvec", F.coalesce("dvec", zero))


# AGG14 -----------------------------------------------------------------------------
def mean_pool(tok_vecs: DataFrame, doc_col: str = "doc_id", vec_col: str = "vec", mask_col: str = "mask",
              dims: int | None = None) -> DataFrame:
    """sum(mask * x) / max(sum(mask), 1e-9) per document (AGG14)."""
    if dims is not None:
        m = F.col(mask_col).cast("double")
        s = tok_vecs.groupBy(doc_col).agg(F.sum(m).alias("_n"), *[
            F.sum(F.col(vec_col)[i].cast("double") * m).alias(f"_s{i}") for i in range(dims)])
        n = F.greatest(F.col("_n"), F.lit(1e-9))
        return s.select(doc_col, F.array(*[F.col(f"_s{i}") / n for i in range(dims)]).alias("pooled"))
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    masked = tok_vecs.select(doc_col, F.col(mask_col).cast("double").alias("_m"),
                             F.transform(vec_col, lambda x: x.cast("double") * F.col(mask_col)).alias("_x"))
    s = masked.groupBy(doc_col).agg(Summarizer.sum(array_to_vector("_x")).alias("_s"), F.sum("_m").alias("_n"))
    return s.select(doc_col, F.transform(vector_to_array("_s", "float64"),
                                         lambda x: x / F.greatest(F.col("_n"), F.lit(1e-9))).alias("pooled"))


# RNK7 / TXT4 ------------------------------------------------------------------------
def keywords(td: DataFrame, word_vectors: DataFrame, dims: int, n: int = 5, block_tokens: int | None = None) -> DataFrame:
    """Top-n token occurrences by cosine to the document vector (duplicates
    consume slots, ties -> later position), returned as a sorted set; a
    document without known tokens keeps its raw tokens.

    Documents are scored in blocks that get each word's vector once, with every
    distinct token's count and its last ``n`` positions - no earlier
    occurrence can be among the best n.  A word with a null vector is not known."""
    def kernel(counts: pa.Table, words: pa.Table) -> pa.Table:
        block, names = _Block(counts, words), counts["token"].combine_chunks()
        last = counts["last"].combine_chunks()
        size, pos = np.asarray(pc.list_value_length(last)).astype(np.int64), np.asarray(last.flatten())
        first = np.cumsum(size) - size
        found, kw = [], []
        for d, at, u, count in block.documents():
            mean = (u * count[:, None]).sum(axis=0) / count.sum()
            norm = np.sqrt((mean * mean).sum())
            cos = np.round(u @ mean / norm, 12) if norm else np.zeros(len(u))
            entry = block.entry[at]
            which = np.repeat(np.arange(len(entry)), size[entry])
            nth = np.arange(len(which)) - np.repeat(np.cumsum(size[entry]) - size[entry], size[entry])
            best = which[np.lexsort((-pos[first[entry[which]] + nth], -cos[which]))[:n]]
            found.append(d)
            kw.append(sorted(set(names.take(pa.array(entry[best])).to_pylist())))
        return pa.table({"doc_id": block.ids.take(pa.array(found, pa.int64())),
                         "keywords": pa.array(kw, pa.list_(pa.string()))})
    stats = [F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_list("pos"), asc=False), 1, n).alias("last")]
    schema = f"doc_id {td.schema['doc_id'].dataType.simpleString()}, keywords array<string>"
    rows, kw = _with_vectors(td, word_vectors.where("vec is not null"), stats, kernel, schema, block_tokens)
    return rows.join(kw, "doc_id", "left").select("doc_id", F.coalesce("keywords", F.col("tokens")).alias("keywords"))


def add_keywords(news: DataFrame, kw: DataFrame, id_col: str = "id") -> DataFrame:
    return news.join(kw.withColumnRenamed("doc_id", id_col), id_col, "left")


# VEC1 / VEC2 -------------------------------------------------------------------------
def vectorize(df: DataFrame, text_col: str, id_col: str = "id", method: str = "hashing",
              dims: int = 1024, word_vectors: DataFrame | None = None, model_udf=None) -> DataFrame:
    """Text -> unit vector (id, vec array<float>).

    'hashing': hashed bag of cleaned tokens (no training, scales linearly);
    'word2vec': mean of given word vectors; 'udf': a user iterator pandas
    UDF (e.g. a transformer) applied in Arrow batches.  Empty input gives an
    empty frame; an empty text gives the zero vector."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array
    if method == "udf":
        return df.select(F.col(id_col).alias("id"), l2_normalize(model_udf(F.col(text_col))).alias("vec"))
    td = df.select(F.col(id_col).alias("doc_id"), clean_tokens(text_col).alias("tokens"))
    if method == "word2vec":
        dv = doc_vector(td, word_vectors, dims)
        return dv.select(F.col("doc_id").alias("id"), l2_normalize("dvec").alias("vec"))
    tf = HashingTF(numFeatures=dims, inputCol="tokens", outputCol="_tf").transform(td)
    return tf.select(F.col("doc_id").alias("id"), l2_normalize(vector_to_array("_tf", "float32")).alias("vec"))


def sentence_vector(df: DataFrame, flat_col: Column, id_col: str = "id", **kw) -> DataFrame:
    """VEC2: the same vectoriser over a flattened text (CLN11 / CLN12)."""
    return vectorize(df.select(F.col(id_col).alias("id"), flat_col.alias("_flat")), "_flat", "id", **kw)


# TXT5-TXT10 (topic model) --------------------------------------------------------------
def fit_topics(td: DataFrame, k: int = 10, no_below: int = 3, no_above: float = 0.5,
               max_iter: int = 20, seed: int = 42):
    """Dictionary (TXT5 on AGG8) + online LDA with a learned document prior.
    Returns (cv_model, lda_model).

    Every iteration sees every document, and the dictionary is not cut: all
    kept terms are used.  Spark ML keeps the k x terms topic matrix and the
    terms on the driver; the term prior stays fixed, it cannot learn it."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizerModel
    terms = filter_extremes(doc_freq(td), td.count(), no_below, no_above)
    vocabulary = [r["term"] for r in terms.orderBy(F.desc("df"), "term").select("term").collect()]
    cvm = CountVectorizerModel.from_vocabulary(vocabulary or [""], inputCol="tokens", outputCol="features")
    lda = LDA(k=k, maxIter=max_iter, optimizer="online", optimizeDocConcentration=True, seed=seed,
              subsamplingRate=1.0, featuresCol="features")
    return cvm, lda.fit(stage_table(cvm.transform(td).select("doc_id", "features"), "bags"))


def assign_topic(td: DataFrame, cvm, lda_model, names: list[str] = TOPIC_NAMES) -> DataFrame:
    """TXT7: arg-max over the full topic mixture -> topic name."""
    from pyspark.ml.functions import vector_to_array
    mix = lda_model.transform(cvm.transform(td)).select(
        "doc_id", vector_to_array("topicDistribution").alias("mix"))
    best = F.array_position("mix", F.array_max("mix"))
    label = F.element_at(F.array(*[F.lit(x) for x in names]), best.cast("int"))
    return mix.select("doc_id", "mix", (best - 1).cast("int").alias("topic_idx"), label.alias("topic"))


def topic_over_time(mix: DataFrame, slices: DataFrame, slice_col: str = "slice") -> DataFrame:
    """TXT9: mean topic weight per (time slice, topic)."""
    ex = mix.join(slices, "doc_id").select(slice_col, F.posexplode("mix").alias("topic_idx", "w"))
    return ex.groupBy(slice_col, "topic_idx").agg(F.avg("w").alias("weight"))


def topic_terms(cvm, lda_model, n: int = 10) -> DataFrame:
    """RNK9: top-n terms per topic (term ids mapped through the vocabulary)."""
    spark = lda_model.describeTopics(n).sparkSession
    vocab = spark.createDataFrame(list(enumerate(cvm.vocabulary)), "term_idx int, term string")
    d = lda_model.describeTopics(n).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "tw"))
    return (d.select("topic", "rank", F.col("tw.termIndices").alias("term_idx"), F.col("tw.termWeights").alias("w"))
            .join(vocab, "term_idx"))


def doc_lengths(td: DataFrame) -> DataFrame:
    return td.select("doc_id", F.size("tokens").alias("length"))


def term_frequencies(td: DataFrame) -> DataFrame:
    return td.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))


def topic_summary(td: DataFrame, cvm, lda_model) -> dict[str, DataFrame]:
    """TXT10: topic-term, doc-topic, document lengths, term frequencies."""
    from pyspark.ml.functions import vector_to_array
    doc_topic = lda_model.transform(cvm.transform(td)).select("doc_id", vector_to_array("topicDistribution").alias("mix"))
    return {"topic_term": topic_terms(cvm, lda_model, 30), "doc_topic": doc_topic,
            "doc_length": doc_lengths(td), "term_frequency": term_frequencies(td)}


def get_topics(td: DataFrame, phrases: DataFrame, word_vectors: DataFrame, dims: int, cvm, lda_model,
               lemmas: DataFrame | None = None, excluded_pos: list[str] | None = None) -> DataFrame:
    """TXT8: tokens -> (lemmas) -> phrases -> 10 keywords -> bag of words -> topic."""
    if lemmas is not None:
        from .relational import lemmatise
        rows = lemmatise(token_rows(td), lemmas, excluded_pos or [])
        td = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_l")) \
            .select("doc_id", F.transform("_l", lambda x: x["token"]).alias("tokens"))
    ph = apply_phrases(td, phrases, "replace")
    kw = keywords(ph, word_vectors, dims, 10).select("doc_id", F.col("keywords").alias("tokens"))
    return assign_topic(kw, cvm, lda_model)
