"""Language-model scores from a sharded Elias-Fano n-gram trie.

The model is an n-gram model with Dirichlet smoothing: the probability of a
word after a context seen c times is ``(count + strength * p) / (c + strength)``
with p its probability after the context without its first word, down to
``(count + 1) / (N + V + 1)`` for the word alone (N tokens, V distinct).  It
learns all n-grams of the training documents; contexts of two or more words
seen fewer than ``LEAST_CONTEXT`` times have no children.

Texts become blocks of about ``BLOCK_TOKENS`` tokens with numbers for words;
a block's distinct n-grams are counted where it lies and sent, with those
that are only to be scored, to the shard of their context.  A shard adds the
counts of all blocks, builds its part of the trie's level (``elias_fano``:
contexts, monotone pointers, words relative to their context, probabilities
in one byte), looks every n-gram up by the successor search and answers
each block with the probabilities.  A context of the next level is a node of
this one, so its shard and its place there come with the answer.

A frequent n-gram is one row per block, so no key is hot; the children of a
context seen more than ``SPLIT`` times are spread over several shards by
their word.  Shards and blocks grow in number with the input, not in size.
Nothing of the corpus but its totals (documents, tokens, N, V) reaches the driver.

Defined cases: a null text is empty and scored for its end alone; training
rows and others are told apart by ``train``; without training rows every
token is unknown; repeated rows and null ids are scored each; an empty table
gives no rows; other columns are passed over, whatever their names.  A text
longer than a block is cut into parts that know the words before them, whose
scores are added up.
"""

from __future__ import annotations

import bisect
import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import documents, stage, text_of
from tidings.llm.elias_fano import Level
from tidings.llm.words import number, ranges, texts_of, words_of

ORDER = 3
#: Weight of the shorter context's probability, in counts.
STRENGTH = 24.0
LEAST_CONTEXT = 2
BLOCK_TOKENS = 1 << 20
SHARD_NGRAMS = 1 << 20
#: Occurrences from which a context's children are spread over shards.
SPLIT = 1 << 19
#: Steps of a quantised log10 probability per unit; 255 is the least.
STEPS = 16

# Numbers of the begin and the end of a text; words begin at 2.
_BEGIN, _END, _WORDS = 0, 1, 2

_BLOCK = ("block long, docs array<long>, parts array<long>, train array<boolean>, sizes binary, skips binary, "
          "codes binary, words binary, n_tokens long, n_train long, n_words long")
_ASK = "shard string, block long, payload binary"
_ANSWER = "level int, shard string, block long, payload binary, tokens long, types long"


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers in few bytes: byte planes, those above the largest number
    left out, compressed."""
    out = []
    for a in arrays:
        kind = np.min_scalar_type(a.max()) if len(a) and a.min() >= 0 else a.dtype
        b = np.ascontiguousarray(a, kind)
        planes = b.view(np.uint8).reshape(len(b), b.itemsize).T.tobytes()
        data = zstandard.ZstdCompressor(level=1).compress(planes)
        out.append(f"{a.dtype.str} {kind.str} {len(a)} {len(data)}\n".encode() + data)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\n", at)
        whole, kind, n, size = data[at:end].split()
        n, size, at = int(n), int(size), end + 1 + int(size)
        kind = np.dtype(kind.decode())
        planes = zstandard.ZstdDecompressor().decompress(data[end + 1:at], max_output_size=max(n * kind.itemsize, 1))
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n).astype(whole.decode(), copy=False))
    return out


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers (none negative) in order, the first place of each, and
    for every place its number's; number and place are sorted as one where both fit."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()) < 1 << (63 - bits):
        both = np.sort(key << bits | np.arange(len(key)))
        order, key = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.diff(key, prepend=-1) != 0
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    return key[new], order[new], which


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-STEPS * np.log10(p)), 0, 255).astype(np.uint8)


_PROBABILITY = 10.0 ** (np.arange(256) / -STEPS)


def probability(code: np.ndarray) -> np.ndarray:
    return _PROBABILITY[code]


def blocks_of(docs: DataFrame, train: Column, order: int = ORDER, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The tokens of all documents in blocks; a document's chunk is the begin
    sign or the ``order - 1`` words before it (``skips``), then its tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, [0, 0]
        held: list = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal held, size
            codes, words = number([w for c in held for w in c[4]])
            # words lie by their hash, so a shard's are a stretch
            words = words.to_pylist()
            by_hash = np.argsort(np.fromiter(map(zlib.crc32, words), np.int64, len(words)), kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[by_hash] = np.arange(len(words))
            codes = rank[codes] + np.int32(_WORDS)
            ends = np.cumsum([len(c[4]) for c in held])
            own = [x for part, c in zip(np.split(codes, ends[:-1]), held)
                   for x in ([_BEGIN][:c[3]], part, [_END][:c[5]])]
            sizes = np.array([len(c[4]) + c[3] + c[5] for c in held])
            skips = np.array([c[6] for c in held])
            made[0] += 1
            row = [first + made[0], [c[0] for c in held], [c[1] for c in held], [c[2] for c in held],
                   pack(sizes), pack(skips), pack(np.concatenate(own).astype(np.int32)),
                   b" ".join([words[i] for i in by_hash.tolist()]), int((sizes - skips).sum()),
                   sum(c[2] and c[3] for c in held), len(words)]
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for b in batches:
            for i, known, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2))):
                words = words_of(text, lower=True)
                cuts = range(0, max(len(words), 1), BLOCK_TOKENS)
                made[1] += len(cuts) > 1
                for lo in cuts:
                    lead = min(lo, order - 1)
                    part = words[lo - lead:lo + BLOCK_TOKENS]
                    held.append((i, first + made[1] if len(cuts) > 1 else None, known, int(lo == 0), part,
                                 int(lo == cuts[-1]), lead if lo else 1))
                    size += len(part) + 2
                    if size >= BLOCK_TOKENS:
                        yield block()
        if held:
            yield block()

    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4,
             *[pa.int64()] * 3]
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(train, F.lit(False)).alias("train"),
                       text_of(text_col).alias("text"))
    return rows.mapInArrow(run, _BLOCK)


class Block:
    """A block's tokens and what the shards have answered about them."""

    def __init__(self, row: dict):
        self.row = row
        (self.codes,), (self.sizes,), (self.skips,) = (unpack(row[c]) for c in ("codes", "sizes", "skips"))
        self.age = ranges(np.zeros(len(self.sizes), np.int64), self.sizes)
        self.own = self.age >= np.repeat(self.skips, self.sizes)
        self.counted = self.own & np.repeat(np.array(row["train"], bool), self.sizes)
        self.n = row["n_words"] + _WORDS

    def words(self) -> list[bytes]:
        return self.row["words"].split(b" ") if self.n > _WORDS else []

    def ask_words(self, shards: int) -> Iterator[tuple[str, bytes]]:
        """Per shard the block's distinct words and their training counts."""
        words = self.words()
        n = np.bincount(self.codes[self.counted], minlength=self.n)[_WORDS:]
        cuts = [bisect.bisect_left(words, s, key=lambda w: zlib.crc32(w) * shards >> 32) for s in range(shards + 1)]
        for s, (lo, hi) in enumerate(itertools.pairwise(cuts)):
            if hi > lo:
                yield str(s), pack(n[lo:hi]) + b"\n\n" + b" ".join(words[lo:hi])

    def learn_words(self, answers: dict[str, bytes], word_shards: int, shards: int, docs: int, tokens: int,
                    types: int) -> None:
        """Numbers and counts of the words, and their probabilities alone.
        As contexts of the next level, words are spread over ``shards``."""
        self.gid, self.count = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        self.gid[:_WORDS], self.count[:_WORDS] = (1, 2), docs
        lo = _WORDS
        for s in range(word_shards):
            if str(s) not in answers:
                continue
            gid, count = unpack(answers[str(s)])
            self.gid[lo:lo + len(gid)], self.count[lo:lo + len(gid)] = gid, count
            lo += len(gid)
        # from here on words are numbered like their global numbers, so a
        # block's n-grams stand in the order of the shards' nodes
        order = np.concatenate([np.arange(_WORDS), _WORDS + np.argsort(self.gid[_WORDS:], kind="stable")])
        rank = np.empty(self.n, np.int64)
        rank[order] = np.arange(self.n)
        self.codes, self.gid, self.count = rank[self.codes], self.gid[order], self.count[order]
        self.alone = (self.count + 1) / (tokens + types + 1)
        self.code = quantise(self.alone)[self.codes]
        self.gram, self.nodes, self.totals = self.codes, self.gid, self.count
        self.seen = self.count > 0
        self.shard = [str(s) for s in range(shards)]
        self.shard_of = (self.gid * 0x9E3779B1 >> 7) % shards

    def n_grams(self, level: int) -> None:
        """The block's distinct n-grams after seen contexts, in the order in
        which they are asked: by shard, context, word."""
        at = np.flatnonzero(self.age >= level - 1)
        at = at[(self.gram[at - 1] >= 0)]
        at = at[self.seen[self.gram[at - 1]]]
        key, first, self.gram_at = distinct(self.gram[at - 1] * self.n + self.codes[at])
        self.at, before, word = at, key // self.n, key % self.n
        self.word, self.context, self.total = self.gid[word], self.nodes[before], self.totals[before]
        pieces = -(-self.total // SPLIT)
        piece = (self.word * 0x85EBCA6B >> 9) % np.maximum(pieces, 1)
        both, self.target = np.unique(self.shard_of[before] << 32 | piece, return_inverse=True)
        self.targets = [self.shard[b >> 32] + (f"/{level}.{b & 0xFFFFFFFF}" if b & 0xFFFFFFFF else "")
                        for b in both.tolist()]
        self.total = np.where(pieces > 1, self.total, 0)
        self.counts = np.bincount(self.gram_at, weights=self.counted[at], minlength=len(key)).astype(np.int32)
        self.lower = self.code[at[first]]
        self.order = np.argsort(self.target.astype(np.uint16 if len(both) < 1 << 16 else np.int64), kind="stable")
        self.bounds = np.searchsorted(self.target[self.order], np.arange(len(both) + 1))

    def ask(self) -> Iterator[tuple[str, bytes]]:
        for k, shard in enumerate(self.targets):
            at = self.order[self.bounds[k]:self.bounds[k + 1]]
            context = self.context[at]
            first = np.flatnonzero(np.diff(context, prepend=-1))
            sizes = np.diff(np.append(first, len(at)))
            yield shard, pack(np.diff(context[first], prepend=0), sizes.astype(np.int32), self.total[at][first],
                              self.word[at], self.counts[at], self.lower[at])

    def learn(self, answers: dict[str, bytes], last: bool) -> None:
        """Probabilities of the n-grams, and their nodes as the next contexts."""
        n = len(self.order)
        code, nodes, totals = np.zeros(n, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k, shard in enumerate(self.targets):
            got = unpack(answers[shard])
            at = self.order[self.bounds[k]:self.bounds[k + 1]]
            code[at] = got[0]
            if not last:
                nodes[at], totals[at] = got[1], got[2]
        self.code[self.at] = code[self.gram_at]
        self.gram = np.full(len(self.codes), -1, np.int64)
        self.gram[self.at] = self.gram_at
        self.seen, self.nodes, self.totals = nodes > 0, nodes, totals
        self.shard, self.shard_of = self.targets, self.target

    def scores(self, tokens: int, types: int) -> list[tuple]:
        """Per chunk: document, part, training row, tokens, known tokens, the
        words' own score and the model's."""
        ends = np.cumsum(self.sizes)

        def total(x):
            sums = np.concatenate([[0], np.cumsum(np.where(self.own, x, 0))])
            return (sums[ends] - sums[ends - self.sizes]).tolist()
        alone = np.log10(self.alone)
        base = [float(alone[self.codes[lo + s:hi]].sum())
                for lo, hi, s in zip((ends - self.sizes).tolist(), ends.tolist(), self.skips.tolist())]
        return list(zip(self.row["docs"], self.row["parts"], self.row["train"], total(1),
                        total(self.count[self.codes] > 0), base,
                        [x / -STEPS for x in total(self.code.astype(np.int64))]))


def _answer(level: int, shard, block, payload, tokens, types) -> pa.Table:
    n = len(block)
    return pa.table([pa.array([level] * n, pa.int32()), pa.array([shard] * n, pa.string()), pa.array(block, pa.int64()),
                     pa.array(payload, pa.binary()), pa.array(tokens, pa.int64()), pa.array(types, pa.int64())],
                    names=["level", "shard", "block", "payload", "tokens", "types"])


def word_level(shards: int):
    """The first level's part in one shard: a number and the count of each
    word of all blocks, the most frequent first; a row without block has the totals."""
    def run(asks: pa.Table) -> pa.Table:
        shard, blocks = asks.column("shard")[0].as_py(), asks.column("block").to_pylist()
        parts = [_cut(p) for p in asks.column("payload").to_pylist()]
        codes, _ = number([w for _, words in parts for w in words])
        n = np.concatenate([x for x, _ in parts])
        count = np.bincount(codes, weights=n).astype(np.int64)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        gid = np.where(count > 0, 3 + rank * shards + int(shard), 0)
        ends = np.cumsum([len(x) for x, _ in parts])
        out = [pack(gid[c], count[c]) for c in np.split(codes, ends[:-1])]
        none = [None] * len(blocks)
        return _answer(1, shard, [*blocks, None], [*out, None], [*none, int(count.sum())], [*none, int((count > 0).sum())])
    return run


def _cut(payload: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Counts and words of an ask."""
    end = payload.index(b"\n")
    size = int(payload[:end].split()[-1])
    return unpack(payload[:end + 1 + size])[0], payload[end + 3 + size:].split(b" ")


def n_gram_level(level: int, last: bool, strength: float, least: int):
    """One shard's part of a level: built from the counts of all blocks, then
    asked for every n-gram that a block has sent."""
    def run(asks: pa.Table) -> pa.Table:
        shard, blocks = asks.column("shard")[0].as_py(), asks.column("block").to_pylist()
        parts = [unpack(p) for p in asks.column("payload").to_pylist()]
        contexts, of_context = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
        sizes, hot, word, n, lower = (np.concatenate([p[i] for p in parts]) for i in range(1, 6))
        of_child = np.repeat(of_context, sizes)
        wide = int(word.max()) + 1
        key, first, which = distinct(of_child * wide + word)
        context, word, p = key // wide, key % wide, probability(lower[first])
        count = np.bincount(which, weights=n).astype(np.int64)
        total = np.bincount(context, weights=count, minlength=len(contexts)).astype(np.int64)
        np.maximum.at(total, of_context, hot)
        seen = count > 0
        children = quantise((count + strength * p) / (total[context] + strength))
        trie = Level.view(Level.of(contexts[context[seen]], word[seen], children[seen]).to_bytes())
        node = trie.find(contexts[context], word)
        code = np.where(node >= 0, trie.codes[np.maximum(node, 0)] if len(trie.codes) else 0,
                        quantise(strength * p / (total[context] + strength)))
        answer = [code.astype(np.uint8)]
        if not last:
            nodes = np.where(count >= least, node + 1, 0)
            answer += [nodes, np.where(count > SPLIT, count, np.minimum(nodes, 1))]
        ends = np.cumsum([len(p[3]) for p in parts])
        out = [pack(*[a[w] for a in answer]) for w in np.split(which, ends[:-1])]
        none = [None] * len(blocks)
        return _answer(level, shard, blocks, out, none, none)
    return run


def score(docs: DataFrame, train: Column, order: int = ORDER, strength: float = STRENGTH,
          least: int = LEAST_CONTEXT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` of every document, the model fitted on the
    rows where ``train`` holds."""
    spark = docs.sparkSession
    # bucketed by block: every level reads the blocks where they lie
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    table = f"lm_blocks_{uuid.uuid4().hex[:12]}"
    blocks_of(docs, train, order, id_col, text_col).write.format("parquet").bucketBy(parts, "block").saveAsTable(table)
    blocks = spark.table(table)
    size = blocks.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words"),
                      F.sum("n_train").alias("docs")).first()
    shards = max(1, -(-(size["tokens"] or 0) // SHARD_NGRAMS))
    word_shards = max(1, -(-(size["words"] or 0) // SHARD_NGRAMS))
    n_docs = size["docs"] or 0

    def ask_words(batches):
        for b in batches:
            for row in b.to_pylist():
                asked = list(Block(row).ask_words(word_shards))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in asked], pa.string()),
                                                  pa.array([row["block"]] * len(asked), pa.int64()),
                                                  pa.array([p for _, p in asked], pa.binary())],
                                                 names=["shard", "block", "payload"])

    known = stage(blocks.mapInArrow(ask_words, _ASK).groupBy("shard").applyInArrow(word_level(word_shards), _ANSWER), "words")
    total = known.where("block is null").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    tokens, types = (total["n"] or 0) + n_docs, (total["v"] or 0) + (n_docs > 0)

    def state(rows: pa.Table, level: int) -> Block:
        """The block as the answers up to ``level`` left it."""
        row = rows.to_pylist()[0]
        by_level = {k: {a["shard"]: a["payload"] for a in row[f"level{k}"] or []} for k in range(1, level + 1)}
        block = Block(row)
        block.learn_words(by_level[1], word_shards, shards, n_docs, tokens, types)
        for k in range(2, level + 1):
            block.n_grams(k)
            block.learn(by_level[k], k == order)
        return block

    def ask(level: int):
        def run(rows: pa.Table) -> pa.Table:
            block = state(rows, level - 1)
            block.n_grams(level)
            asked = list(block.ask())
            return pa.table([pa.array([s for s, _ in asked], pa.string()),
                             pa.array([block.row["block"]] * len(asked), pa.int64()),
                             pa.array([p for _, p in asked], pa.binary())], names=["shard", "block", "payload"])
        return run

    def scores(rows: pa.Table) -> pa.Table:
        columns = list(zip(*state(rows, order).scores(tokens, types)))
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)],
                        names=["doc_id", "part", "train", "n_tokens", "n_known", "base_score", "score"])

    def with_answers(rows: DataFrame, answers: DataFrame, level: int) -> DataFrame:
        """Every block with the list of its answers, which alone are moved."""
        mine = answers.where("block is not null").groupBy("block").agg(
            F.collect_list(F.struct("shard", "payload")).alias(f"level{level}"))
        return rows.join(mine, "block", "left")

    rows = with_answers(blocks, known, 1)
    for level in range(2, order + 1):
        asks = rows.groupBy("block").applyInArrow(ask(level), _ASK)
        rows = with_answers(rows, asks.groupBy("shard").applyInArrow(
            n_gram_level(level, level == order, strength, least), _ANSWER), level)
    chunks = rows.groupBy("block").applyInArrow(
        scores, "doc_id long, part long, train boolean, n_tokens long, n_known long, base_score double, score double")
    columns = ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"]
    chunks = stage(chunks, "chunks")
    spark.sql(f"DROP TABLE {table}")
    whole = chunks.where("part is null").select(*columns)
    cut = chunks.where("part is not null").groupBy("part").agg(
        F.first("doc_id").alias("doc_id"), F.first("train").alias("train"),
        *[F.sum(c).alias(c) for c in columns[2:]]).select(*columns)
    return whole.unionByName(cut).withColumn("train_tokens", F.lit(tokens).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score(documents(spark, sf_dir), ~held_out).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
