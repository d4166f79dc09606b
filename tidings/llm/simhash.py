"""SimHash near-duplicates: pivot distance tables over 64-bit fingerprints.

Fingerprints are computed where the documents lie (Arrow batches, texts are
never shuffled).  Equal fingerprints are one node.  A table gives every node
its Hamming distances to ``N_PIVOTS`` reference fingerprints; by the triangle
inequality two nodes within ``max_bits`` differ by at most ``max_bits`` in
every coordinate, so a pair with a larger coordinate difference is discarded
before its bits are compared, and survivors are verified.

A pivot table alone would compare every pair of rows.  The pairs that it
looks at come from an exact split by the pigeonhole principle: of
``N_BLOCKS`` bit blocks, two fingerprints within ``max_bits`` agree on at
least ``N_BLOCKS - max_bits``, so they share one of the keys formed by the
combinations of that many blocks.  Nodes are shuffled and sorted by key and
compared inside their key in numpy, which returns a spanning star per
component and never the pairs; a key with more than ``KEY_ROWS`` nodes is cut into
sub-blocks that are compared block against block in tasks of their own,
all of them.  Components come from ``components``.

Defined cases: a null text is empty; a text without words has fingerprint
zero and is linked like any other; a null id is returned as null, and the
component of only null ids is null; repeated rows are returned as often as
they come; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import (LONG_MIN, components, documents, join_per_key, keep_rows, stage,
                                text_of)

N_BLOCKS = 7
N_PIVOTS = 16
KEY_ROWS = 4096
SAMPLE_STEP = 64
#: A-Z to a-z, every other byte unchanged.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PIECE = 1 << 20


def _word_pieces(data: bytes) -> Iterator[list[bytes]]:
    """Words between ASCII white space, a bounded piece of the text at a time."""
    if len(data) <= _PIECE:
        yield data.split()
        return
    start = 0
    while start < len(data):
        end = min(start + _PIECE, len(data))
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[start:end].split()
        start = end


def fingerprint(text: str, shingle: int = 4) -> int:
    """Bit i is set when it is set in over half of the shingles' hashes."""
    ones, n, words = np.zeros(64, np.int64), 0, []
    digest, join = xxhash.xxh64_intdigest, b" ".join

    def add(w: list[bytes]) -> None:
        nonlocal ones, n
        h = np.array([digest(join(w[i:i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))],
                     dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
        n += len(h)

    for piece in _word_pieces(text.encode("utf-8", "surrogatepass").translate(_LOWER)):
        words += piece
        if len(words) >= shingle:
            add(words)
            words = words[len(words) - shingle + 1:]
    if n == 0 and words:
        add(words)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id``, ``key`` (a 64-bit hash of the text) and ``fp`` of every document."""
    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())],
                                             names=["id", "key", "fp"])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"),
                       text_of(text_col).alias("text"))
    return stage(rows.mapInArrow(run, "id long, key long, fp long"), "fingerprints")


def text_key(text_col: str = "text") -> Column:
    return F.xxhash64(text_of(text_col))


def _pivots(n: int) -> list[int]:
    """The reference fingerprints."""
    rng = np.random.default_rng(10)
    return [int(x) for x in rng.integers(-2 ** 63, 2 ** 63, n, dtype=np.int64)]


def pivot_table(nodes: DataFrame) -> DataFrame:
    """Adds the distances of ``fp`` to the reference fingerprints, a byte each:
    ``d0`` holds the first eight of them, ``d1`` the others."""
    packed = []
    for eight in itertools.batched(_pivots(N_PIVOTS), 8):
        d = F.lit(0).cast("long")
        for i, p in enumerate(eight):
            d = d.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * i))
        packed.append(d)
    return nodes.withColumns({"d0": packed[0], "d1": packed[1]})


def _keys(max_bits: int, n_blocks: int) -> Column:
    """One key for every combination of ``n_blocks - max_bits`` bit blocks."""
    cuts = [64 * i // n_blocks for i in range(n_blocks + 1)]
    parts = []
    for lo, hi in itertools.pairwise(cuts):
        mask = (1 << (hi - lo)) - 1
        parts.append((hi - lo, F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(mask))))
    keys = []
    for i, chosen in enumerate(itertools.combinations(parts, n_blocks - max_bits)):
        key = F.lit(i).cast("long")
        for width, part in chosen:
            key = F.shiftleft(key, width).bitwiseOR(part)
        keys.append(key)
    return F.explode(F.array(*keys))


def _links(fa, da, fb, db, max_bits: int) -> np.ndarray:
    fa, fb = np.broadcast_arrays(fa, fb)
    near = np.abs(da - db).max(axis=1) <= max_bits
    near[near] = np.bitwise_count((fa[near] ^ fb[near]).view(np.uint64)) <= max_bits
    return near


def _star(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of ``n`` items' component under links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        nxt = root.copy()
        for side in (a, b):
            np.minimum.at(nxt, root[side], low)
            np.minimum.at(nxt, side, low)
        nxt = nxt[nxt]
        if np.array_equal(nxt, root):
            break
        root = nxt
    return root


def _edges(fp: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    far = root != np.arange(len(root))
    return pa.RecordBatch.from_arrays([pa.nulls(int(far.sum()), pa.int64()), pa.array(fp[far], pa.int64()),
                                       pa.array(fp[root[far]], pa.int64())], names=["key", "a", "b"])


def _dist(d0, d1) -> np.ndarray:
    return np.stack([d0, d1], axis=1).view(np.int8).astype(np.int16)


def _compare_runs(max_bits: int, key_rows: int):
    """Rows sorted by key: links inside each run of one key, all its pairs by
    distance in the order, so that numpy works on all runs of a piece at once.
    A run of more than ``key_rows`` is not compared; its key is returned."""
    def piece(key, fp, d0, d1):
        dist, ia, ib, lag = _dist(d0, d1), [], [], 1
        at = np.flatnonzero(key[1:] == key[:-1])
        while len(at):
            ok = _links(fp[at], dist[at], fp[at + lag], dist[at + lag], max_bits)
            ia.append(at[ok])
            ib.append(at[ok] + lag)
            lag += 1
            at = at[at + lag < len(key)]
            at = at[key[at] == key[at + lag]]
        if ia:
            yield _edges(fp, _star(len(fp), np.concatenate(ia), np.concatenate(ib)))

    def run(batches):
        rest, skip = None, None
        for b in itertools.chain(batches, [None]):
            if b is None:
                now, rest = rest, None
            else:
                now = tuple(b.column(i).to_numpy() for i in range(4))
                if skip is not None:
                    now = tuple(x[now[0] != skip] for x in now)
                if rest is not None:
                    now = tuple(np.concatenate(x) for x in zip(rest, now))
                last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
                now, rest = tuple(x[:last] for x in now), tuple(x[last:] for x in now)
                if len(rest[0]) > key_rows:
                    skip, rest = rest[0][0], None
                    yield pa.RecordBatch.from_arrays([pa.array([skip], pa.int64())] + [pa.nulls(1, pa.int64())] * 2,
                                                     names=["key", "a", "b"])
            if now is not None:
                yield from piece(*now)
    return run


def _compare_blocks(max_bits: int):
    """All pairs between two sub-blocks (or inside one) of a large key."""
    def run(key, table):
        fp, side = table["fp"].to_numpy(), table["side"].to_numpy()
        dist = _dist(table["d0"].to_numpy(), table["d1"].to_numpy())
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        ia, ib = [], []
        for i in left:
            ok = right[_links(fp[i], dist[i], fp[right], dist[right], max_bits)]
            ia.append(np.full(len(ok), i))
            ib.append(ok)
        root = _star(len(fp), np.concatenate(ia), np.concatenate(ib)) if ia else np.arange(len(fp))
        return pa.Table.from_batches([_edges(fp, root)])
    return run


def near_edges(nodes: DataFrame, max_bits: int = 4, n_blocks: int = N_BLOCKS, key_rows: int = KEY_ROWS) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints that have the same
    components as all pairs within ``max_bits``.

    One node in ``SAMPLE_STEP`` shows which keys may be large; those skip the
    shuffle by key.  A large key that the sample missed is met there and goes
    the same way; the sample decides nothing but the way.
    """
    table = pivot_table(nodes.select("fp"))
    keyed = table.withColumn("key", _keys(max_bits, n_blocks))
    sample = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE_STEP)) == 0).select(
        _keys(max_bits, n_blocks).alias("key"))
    large = stage(sample.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") > max(1, key_rows // (2 * SAMPLE_STEP))).select("key"), "simhash-large")
    runs = stage(keyed.join(large, "key", "left_anti").select("key", "fp", "d0", "d1")
                 .repartition("key").sortWithinPartitions("key")
                 .mapInArrow(_compare_runs(max_bits, key_rows), "key long, a long, b long"), "simhash-links")
    edges = runs.where("key is null").select("a", "b")
    large = large.unionByName(runs.where("key is not null").select("key").distinct())
    if large.isEmpty():
        return edges
    members = keyed.join(large, "key")
    parts = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / key_rows).cast("long").alias("m"))
    blocked = members.join(stage(parts, "simhash-parts"), "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("m")))
    blocked = blocked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    blocked = blocked.select("key", "fp", "d0", "d1", F.least("own", "other").alias("i"),
                             F.greatest("own", "other").alias("j"),
                             (F.col("own") > F.col("other")).cast("int").alias("side"))
    blocks = blocked.groupBy("key", "i", "j").applyInArrow(_compare_blocks(max_bits), "key long, a long, b long")
    return edges.unionByName(blocks.select("a", "b"))


def near_groups(fps: DataFrame, max_bits: int = 4, **options) -> DataFrame:
    """``fps`` (``id``, ``key``, ``fp``) with the ``root`` fingerprint of each
    row's component and, as ``component``, the smallest id reachable over links
    of at most ``max_bits`` bits."""
    nodes = stage(fps.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    roots = components(near_edges(nodes, max_bits, **options), "simhash-cc")
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    of_root = joined.groupBy("root").agg(F.min("low").alias("component"))
    linked = joined.join(of_root, "root").select("fp", "root", "component")
    labels = stage(nodes.join(linked, "fp", "left").select(
        "fp", "n", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("component")).alias("component")),
        "simhash-labels")
    return join_per_key(fps, labels, "fp", "n", fps.count())


def simhash_dedup(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                  text_col: str = "text", **options) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``."""
    groups = near_groups(fingerprints(docs, shingle, id_col, text_col), max_bits, **options)
    return groups.select(F.col("id").alias("doc_id"),
                         F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.col("component").alias("component_id"))


def kept_documents(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id
    (null ids last; of equal ids with different texts, the smallest text hash)."""
    groups = near_groups(fingerprints(docs, shingle, id_col, text_col), max_bits)
    first = F.struct(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(LONG_MIN)).alias("id"), "key")
    by_text = groups.groupBy("root", "id", "key").agg(F.count(F.lit(1)).alias("same"))
    kept = by_text.groupBy("root").agg(F.min(F.struct(first.alias("f"), "same")).alias("k"))
    kept = stage(kept.select("k.f.id", "k.f.key", "k.same"), "simhash-kept")
    return keep_rows(docs, kept, id_col, text_key(text_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir))
