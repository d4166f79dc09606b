"""Periodic runs of words by string synchronising sets.

A run is a maximal stretch of words with smallest period q and length at least
``max(least, 2 q)``.  Documents are searched where they lie, many at once: their
words' numbers stand in one array, with a number of its own after each
document, so no run crosses.

* Periods up to ``SMALL``: the highly periodic regions are detected separately,
  by comparing the array with itself shifted.
* Scale t = 4, 8, 16, ... finds the periods 3t-1 to 6t-2.  Every position has a
  hash of its next t words, put together from two hashes of the scale before.
  Position i is in the synchronising set (Kempa and Kociumaka 2019) if the
  least hash of i..i+t is that of i or of i+t; positions whose t words have a
  period of t/3 or less (they lie in a run found before) are left out.
  Membership depends on the next 2t words alone, and t consecutive positions
  without a member are highly periodic.  So a run has a member among its
  first positions, whose context of 2t words comes again one period later:
  pairs of members with equal contexts at such a distance propose periods.
* Where two highly periodic regions of one small period touch, the words around
  may have no member at all; there the regions themselves propose the
  periods that bring one into the other.

Proposals are joined to stretches, compared word by word and extended to both
sides, so hashes only propose.  Of the periods of one stretch the smallest
stays.  Equal contexts of members are at least t/3 apart, so a member has a
bounded number of partners, and all are looked at.

Defined cases: a null or empty text has no runs and an empty collapsed text;
repeated rows and null ids are returned as they come; an empty table gives no rows;
other columns are passed over, whatever their names.  A long text is one
array in its task (about 60 bytes per word); texts are never cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import documents, text_of
from tidings.llm.words import number, texts_of, words_of

LEAST = 12
#: Periods that are found by shifting; the first scale begins after it.
SMALL = 10
#: Words of documents that are searched together, at least one document.
GROUP_WORDS = 1 << 19
_MAX = np.uint64(2 ** 64 - 1)

_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()),
                                                 ("period", pa.int64())]))), ("collapsed", pa.string())])
_Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # start, end, period


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring stretches from their hashes."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _shifted(codes: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches [lo, hi) of places equal to the place ``p`` later."""
    same = np.zeros(max(len(codes) - p, 0) + 2, np.int8)
    same[1:-1] = codes[:-p] == codes[p:] if len(codes) > p else 0
    turns = np.flatnonzero(np.diff(same))
    return turns[::2], turns[1::2]


def members(names: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """The synchronising set from the hashes of t words and the mask of the
    highly periodic positions."""
    ids = np.where(periodic, _MAX, names)
    n = len(ids) - t
    if n <= 0:
        return np.empty(0, np.int64)
    low, w = ids, 1
    while w < t:
        low, w = np.minimum(low[:-w], low[w:]), 2 * w
    low = np.minimum(low[:n], ids[t:])
    return np.flatnonzero((low != _MAX) & ((low == ids[:n]) | (low == ids[t:])))


def _equal_contexts(at: np.ndarray, context: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of members with the same context ``least`` to ``most`` apart."""
    order = np.argsort(context, kind="stable")
    x, c = at[order], context[order]
    live, lag, found = np.arange(len(x)), 0, []
    while live.size:
        lag += 1
        live = live[live + lag < len(x)]
        gap = x[live + lag] - x[live]
        near = (c[live] == c[live + lag]) & (gap <= most)
        live, gap = live[near], gap[near]
        found.append((x[live[gap >= least]], gap[gap >= least]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _touching(codes: np.ndarray, runs: _Runs, least: int, most: int) -> list[tuple[int, int, int]]:
    """(lo, hi, period) of stretches at which a highly periodic region is
    repeated by another one of the same period that touches it."""
    start, end, period = runs
    order = np.lexsort((start, period))
    out = []
    for a, b in zip(order[:-1], order[1:]):
        q, b1, e1, b2, e2 = int(period[a]), int(start[a]), int(end[a]), int(start[b]), int(end[b])
        if period[b] != q or b2 > e1:
            continue
        first = codes[b1:b1 + q]
        turn = next((d for d in np.flatnonzero(codes[b2:b2 + q] == first[0]).tolist()
                     if np.array_equal(codes[b2 + d:b2 + d + q], first)), None)
        if turn is None:
            continue
        base = (b2 + turn - b1) % q
        lowest = base + -(-max(least - base, 0) // q) * q
        for p in range(lowest, min(most, e1 - b1, e2 - b2) + 1, q):
            lo, hi = max(b1, b2 - p), min(e1, e2 - p)
            if lo < hi:
                out.append((lo, hi, p))
    return out


def _grown(codes: np.ndarray, at: np.ndarray, p: np.ndarray, step: int) -> np.ndarray:
    """The place at which equality with the place ``p`` later ends, from
    ``at`` on to the right (step 1) or left (step -1), for every row."""
    at, n, width = at.copy(), len(codes), 16
    live = np.arange(len(at))
    while live.size:
        idx = at[live, None] + step * np.arange(width)
        far = idx + p[live, None]
        same = (idx >= 0) & (far < n)
        same &= codes[np.clip(idx, 0, n - 1)] == codes[np.clip(far, 0, n - 1)]
        size = np.where(same.all(1), width, same.argmin(1))
        at[live] += step * size
        live = live[size == width]
        width = max(16, min(2 * width, (1 << 21) // max(len(live), 1)))
    return at


def _merged(lo: np.ndarray, hi: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one period that overlap or touch as one."""
    order = np.lexsort((lo, p))
    lo, hi, p = lo[order], hi[order], p[order]
    base = np.unique(p, return_inverse=True)[1] * (int(hi.max()) + 1)
    ends = np.maximum.accumulate(hi + base)
    new = np.concatenate([[True], lo[1:] + base[1:] > ends[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])
    return lo[new], (ends - base)[last], p[new]


def _smallest(runs: list[_Runs]) -> _Runs:
    """Every stretch once, with its smallest period, by start, end."""
    start, end, period = (np.concatenate([r[i] for r in runs]) for i in range(3))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], end[first], period[first]


def find_runs(codes: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> _Runs:
    """``start``, ``end`` and smallest ``period`` of every run in ``codes``, the
    documents' words one after the other, each document (``sizes`` words) with
    a number of its own behind it; by start, then end."""
    runs: list[_Runs] = [(np.empty(0, np.int64),) * 3]
    for p in range(1, SMALL + 1):
        lo, hi = _shifted(codes, p)
        keep = hi - lo >= max(p, min(least, 4) - p)
        runs.append((lo[keep], hi[keep] + p, np.full(int(keep.sum()), p)))
    found = _smallest(runs)
    place = np.arange(len(codes))
    names, length, t = codes.astype(np.uint64), 1, (SMALL + 2) // 3
    names = _joined(names, names)
    sizes = sizes + 1
    while True:
        stay = sizes - 1 >= 2 * (3 * t - 1)
        if not stay.any():
            break
        if not stay.all():
            mask = np.repeat(stay, sizes)
            # hashes are one shorter per word of their length; those of the end are never used
            names = names[mask[:len(names)]]
            codes, place, sizes = codes[mask], place[mask], sizes[stay]
        while length < t:
            names, length = _joined(names[:-length], names[length:]), 2 * length
        wide = _joined(names[:-t], names[t:])
        start = np.searchsorted(place, found[0])
        here = (start < len(place)) & (place[np.minimum(start, len(place) - 1)] == found[0])
        here &= (3 * found[2] <= t) & (found[1] - found[0] >= t)
        start, size, period = start[here], (found[1] - found[0])[here], found[2][here]
        turns = np.zeros(len(names) + 1, np.int64)
        np.add.at(turns, np.minimum(start, len(names)), 1)
        np.add.at(turns, np.minimum(start + size - t + 1, len(names)), -1)
        at = members(names, t, np.cumsum(turns[:-1]) > 0)
        at, gap = _equal_contexts(at, wide[at], 3 * t - 1, 6 * t - 2)
        long = size >= 3 * t - 1
        extra = np.array(_touching(codes, (start[long], (start + size)[long], period[long]), 3 * t - 1, 6 * t - 2),
                         np.int64).reshape(-1, 3)
        lo = np.concatenate([at, extra[:, 0]])
        if len(lo):
            lo, hi, p = _merged(lo, np.concatenate([at + 2 * t, extra[:, 1]]), np.concatenate([gap, extra[:, 2]]))
            end = _grown(codes, lo, p, 1)
            true = end >= hi  # word by word, not by hash
            lo, end, p = lo[true], end[true], p[true]
            lo = _grown(codes, lo - 1, p, -1) + 1
            run = end - lo >= p
            found = _smallest([found, (place[lo[run]], place[lo[run]] + (end - lo + p)[run], p[run])])
        names, length, t = wide, 2 * t, 2 * t
    keep = found[1] - found[0] >= np.maximum(least, 2 * found[2])
    return found[0][keep], found[1][keep], found[2][keep]


def _search(ids: list, docs: list[list[bytes]], least: int) -> pa.RecordBatch:
    """The result rows of some documents, given as lists of words."""
    sizes = np.array([len(w) for w in docs], np.int64)
    flat, distinct = number([w for words in docs for w in words])
    ends = np.cumsum(sizes)
    codes = np.insert(flat.astype(np.int64), ends, len(distinct) + np.arange(len(docs)))
    start, end, period = find_runs(codes, sizes, least)
    begin = ends - sizes + np.arange(len(docs))
    doc = np.searchsorted(begin, start, side="right") - 1
    bounds = np.searchsorted(doc, np.arange(len(docs) + 1))
    local, size = start - begin[doc], end - start
    order = np.lexsort((period, local, doc))
    local, size, period = local[order], size[order], period[order]
    texts = []
    for words, lo, hi in zip(docs, bounds[:-1].tolist(), bounds[1:].tolist()):
        if lo < hi:
            turns = np.zeros(len(words) + 1, np.int64)
            np.add.at(turns, local[lo:hi] + period[lo:hi], 1)
            np.add.at(turns, local[lo:hi] + size[lo:hi], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(turns[:-1]) == 0).tolist()]
        texts.append(b" ".join(words))
    runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in (local, size, period)], ["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), runs,
                                       pa.array(texts, pa.binary()).cast(pa.string())], schema=_ARROW)


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
                  edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per document ``doc_id``, ``n_words``, its ``runs`` (start, length,
    period, by start, then period) and the ``collapsed`` text: the words, one
    blank between, without those that a run holds after its first period.
    ``edit`` may change the words of a document before the search."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                words = words_of(text)
                ids.append(i)
                held.append(edit(i, words) if edit else words)
                n += len(held[-1]) + 1
                if n >= GROUP_WORDS:
                    yield _search(ids, held, least)
                    ids, held, n = [], [], 0
        if ids:
            yield _search(ids, held, least)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, _SCHEMA)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's input: every tenth document by the CRC-32 of its id repeats
    words from place a on with period p."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or n == 0 or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a:a + p]
    return words[:a] + (cycle * (-(-(n - a) // p)))[:n - a]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(documents(spark, sf_dir), edit=planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]),
                                                                F.lit("\n"))), "")
    found = found.withColumns({"best": longest, "lines": lines})
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
