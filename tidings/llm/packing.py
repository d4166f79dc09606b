"""Best-fit packing by minimum bin slack.

Documents are tokenised where they lie; a document is its token ids and an
end id.  Documents longer than a sequence are cut so that only the first piece is
shorter than a sequence.  Which lengths go together is decided on the
histogram of piece lengths, which has at most ``SEQUENCE`` rows whatever the
corpus: for one bin after the other the longest length left is taken, a
bitset subset-sum dynamic programme over the available lengths finds the
fullest feasible combination with it, and the combination is removed - as
often in a row as its lengths last, because the programme would find it
again.  Pieces are then dealt to the combinations' places by their rank
among pieces of equal length; ranks are counted in bounded groups, so a length
that a third of all pieces have is no hot group.

Defined cases: a null text is empty and packed as its end id alone; repeated
rows are packed each; ids need not be unique or non-null; an empty table gives no
rows; other columns are passed over, whatever their names.  A long text is
tokenised whole, in one task.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.llm.common import documents, stage, text_of

SEQUENCE = 2048
END_ID = 0
RANK_ROWS = 1_000
_VOCABULARY, _RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


#: What the rank file's encoder leaves to the tokenizer: very long stretches
#: of one kind, on which its pattern or its merging is slow.
_LONG = re.compile(r"\S{1000}|\s{1000}")


class Encoder:
    """Token ids of a text, as ``tokenizers`` gives them in a plain call.

    Where a rank file of the same vocabulary is given, ordinary texts are
    encoded with it, which is several times faster and gives the same ids; texts
    with the string of a special token, which the plain call takes as that
    token, and texts with a very long stretch go to the tokenizer itself.
    """

    def __init__(self, vocabulary: str, ranks: str | None):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = None
        if ranks:
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as f:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known,
                                            special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.ranked and not any(t in text for t in self.special) and not _LONG.search(text):
            return np.array(self.ranked.encode_ordinary(text), "<u4")
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


@lru_cache(maxsize=2)
def _encoder(vocabulary: str, ranks: str | None) -> Encoder:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(vocabulary, ranks)


def _vocabulary(name: str | None) -> str | None:
    if name is None or "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, vocabulary: str = _VOCABULARY, ranks: str | None = _RANKS,
                 sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """The pieces of every document: ``doc_id``, ``piece``, ``start``,
    ``length``, ``ids_crc32`` and, if wanted, the token ``ids`` themselves.
    ``vocabulary`` is a file of the tokenizer package or a path, ``ranks`` a
    rank file of the same vocabulary or None."""
    def run(batches):
        encode = _encoder(_vocabulary(vocabulary), _vocabulary(ranks)).encode
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = np.append(encode(text), np.uint32(END_ID)).astype("<u4", copy=False)
                n = len(data)
                first = n % sequence or sequence
                start, piece, length = 0, 0, min(first, n)
                while start < n:
                    part = data[start:start + length]
                    for to, v in zip(out, (i, piece, start, length, zlib.crc32(part),
                                           part if with_ids else None)):
                        to.append(v)
                    start, piece, length = start + length, piece + 1, sequence
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            if not with_ids:
                out, names = out[:5], names[:5]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return stage(rows.mapInArrow(run, schema), "pieces")


def fullest(avail: dict[int, int], room: int) -> Counter:
    """The combination of available lengths with the largest sum up to
    ``room``: bitset dynamic programme (bit s: sum s can be reached), lengths
    in falling order with their number split into powers of two; of equally
    full combinations the one that uses the longest lengths earliest."""
    items, reach = [], [1]
    limit = (1 << (room + 1)) - 1
    for length in sorted((x for x in avail if x <= room and avail[x] > 0)):
        left, k = min(avail[length], room // length), 1
        while left:
            take = min(k, left)
            items.append((length, take))
            reach.append((reach[-1] | reach[-1] << (length * take)) & limit)
            left, k = left - take, 2 * k
    at, found = reach[-1].bit_length() - 1, Counter()
    for (length, take), before in zip(reversed(items), reversed(reach[:-1])):
        w = length * take
        if at >= w and before >> (at - w) & 1:
            found[length] += take
            at -= w
    return found


def combinations(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, Counter]]:
    """Minimum bin slack on a histogram: (number of bins, lengths of each)."""
    avail, out = {k: v for k, v in histogram.items() if v > 0}, []
    while avail:
        top = max(avail)
        avail[top] -= 1
        combo = fullest(avail, sequence - top)
        avail[top] += 1
        combo[top] += 1
        times = min(avail[x] // m for x, m in combo.items())
        for x, m in combo.items():
            avail[x] -= m * times
            if not avail[x]:
                del avail[x]
        out.append((times, combo))
    return out


def _places(spark: SparkSession, histogram: dict[int, int], sequence: int) -> DataFrame:
    """One row per combination and length: ranks ``lo`` to ``hi`` of that
    length fill ``m`` places from ``first`` on in the bins from ``bin`` on."""
    rows, used, bin_no = [], Counter(), 0
    for times, combo in combinations(histogram, sequence):
        at = 0
        for length in sorted(combo, reverse=True):
            m = combo[length]
            rows.append((length, used[length], used[length] + times * m, m, bin_no, at))
            used[length] += times * m
            at += length * m
        bin_no += times
    return spark.createDataFrame(rows, "length long, lo long, hi long, m long, bin long, first long")


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to staged ``pieces``."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = spark.createDataFrame([(k, -(-n // RANK_ROWS)) for k, n in counts.items()], "length long, g long")
    # at most one row per length, whatever the corpus
    dealt = pieces.join(F.broadcast(groups), "length").withColumn(
        "g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("g")))
    sizes = dealt.groupBy("length", "g").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    in_group = Window.partitionBy("length", "g").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(in_group) - 1).join(bases, ["length", "g"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("g", "base")
    # one row per length of each combination: bounded by the histogram
    places = F.broadcast(_places(spark, counts, sequence))
    fits = (ranked["length"] == places["length"]) & (ranked["rank"] >= places["lo"]) & (ranked["rank"] < places["hi"])
    step = ranked["rank"] - places["lo"]
    return ranked.join(places, fits).select(
        *[ranked[c] for c in pieces.columns],
        (places["bin"] + F.floor(step / places["m"])).cast("long").alias("sequence_id"),
        (places["first"] + F.pmod(step, places["m"]) * ranked["length"]).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str = _VOCABULARY, ranks: str | None = _RANKS,
                   sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text",
                   with_ids: bool = False) -> DataFrame:
    """The pieces of every document with their place in a sequence."""
    return pack(token_pieces(docs, vocabulary, ranks, sequence, id_col, text_col, with_ids), sequence)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and the ``ids`` of each sequence (``with_ids`` pieces);
    a group holds at most one sequence's tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
