"""Skip-gram word vectors with negative sampling, learnt block by block.

Every block of documents starts from the same vectors, learns its own words and
gives back a vector per word; a word's vectors are averaged over the blocks by
its occurrences there (parameter averaging, as Spark ML's Word2Vec does over
partitions).  A block holds the vectors of its own words alone, and no process
those of the vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Neighbouring positions learnt in one step, and the words that they share as negatives.
STEP, SHARED = 1024, 64
#: Negatives a pair counts for, the power of their counts, and the step width.
NEGATIVES, POWER, RATE = 5, 0.75, 0.1


def first_vectors(seeds: np.ndarray, size: int) -> np.ndarray:
    """A word's first vector from its 64-bit seed alone (splitmix64), so that
    all blocks start alike: uniform within 0.5 / size of zero."""
    x = np.empty((len(seeds), size), np.float32)
    with np.errstate(over="ignore"):
        for j in range(size):
            z = seeds.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(j + 1)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x[:, j] = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53 - 0.5
    return x / np.float32(size)


class _Rows:
    """Vectors that are moved by gradients; a row's steps get smaller with the
    gradients that it has had (Adagrad, one sum per row)."""

    def __init__(self, x: np.ndarray):
        self.x, self.had = x, np.zeros(len(x), np.float32)

    def move(self, at: np.ndarray, gradients: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        row, g = at[order[first]], np.add.reduceat(gradients[order], first, axis=0)
        self.had[row] += (g * g).mean(axis=1)
        self.x[row] += np.float32(RATE) * g / (np.sqrt(self.had[row]) + np.float32(1e-8))[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def learn(codes: np.ndarray, text: np.ndarray, n: np.ndarray, inner: np.ndarray, outer: np.ndarray, window: int,
          rng: np.random.Generator) -> None:
    """One pass over the positions, in place: the word at a position predicts
    those that have it in their window (1 to ``window`` wide, drawn for each) and
    the same ``text``; ``n`` are the words' counts."""
    inputs, outputs = _Rows(inner), _Rows(outer)
    share = np.cumsum(np.asarray(n, np.float64) ** POWER)
    for lo in range(0, len(codes), STEP):
        # positions after the step are there as partners only
        at, doc, own = codes[lo:lo + STEP + window], text[lo:lo + STEP + window], min(STEP, len(codes) - lo)
        reach = rng.integers(1, window + 1, len(at))
        negative = np.searchsorted(share, rng.random(SHARED) * share[-1], side="right")
        a, b = inputs.x[at], outputs.x[at]
        da, db, asked = np.zeros_like(a), np.zeros_like(b), np.zeros(len(at), np.float32)
        for d in range(1, window + 1):
            m = min(own, len(at) - d)
            if m <= 0:
                break
            left, right = slice(0, m), slice(d, m + d)
            same = doc[left] == doc[right]
            for i, o in ((left, right), (right, left)):
                there = (same & (reach[o] >= d)).astype(np.float32)
                g = (there * (1.0 - _sigmoid(np.einsum("ij,ij->i", a[i], b[o])))).astype(np.float32)[:, None]
                da[i] += g * b[o]
                db[o] += g * a[i]
                asked[i] += there
        c = outputs.x[negative]
        g = -_sigmoid(a @ c.T) * (asked * np.float32(NEGATIVES / SHARED))[:, None]
        da += g @ c
        inputs.move(at, da)
        outputs.move(np.concatenate([at, negative]), np.concatenate([db, g.T @ a]))


def learn_block(size: int, window: int, seed: int, last: bool):
    """Kernel of a block: its texts (``row``, ``tokens``) and its words (``word``,
    ``n`` in all texts, ``here`` in the block, ``seed``, ``vec`` learnt before or null)."""
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        inner = first_vectors(words["seed"].to_numpy(), size)
        outer = np.zeros_like(inner)
        before = words["vec"].combine_chunks()
        known = np.asarray(before.is_valid())
        if known.any():
            x = before.drop_null().flatten().to_numpy().reshape(-1, 2 * size)
            inner[known], outer[known] = x[:, :size], x[:, size:]
        # a word's and a text's place do not depend on how the rows arrived
        name = words["word"].combine_chunks()
        by_name = np.asarray(pc.sort_indices(name))
        place = np.empty(len(name), np.int64)
        place[by_name] = np.arange(len(name))
        inner, outer = inner[by_name], outer[by_name]
        docs = docs.sort_by("row")
        tokens = docs["tokens"].combine_chunks()
        text = np.repeat(np.arange(len(tokens)), np.asarray(pc.list_value_length(tokens)))
        code = np.asarray(pc.fill_null(pc.index_in(tokens.flatten(), value_set=name, skip_nulls=True), -1))
        there = code >= 0
        rng = np.random.default_rng([seed & 0xFFFFFFFF, len(text), len(name)])
        if there.any():
            learn(place[code[there]], text[there], words["n"].to_numpy()[by_name], inner, outer, window, rng)
        x = inner if last else np.concatenate([inner, outer], axis=1)
        return _table(name.take(pa.array(by_name)), words["here"].to_numpy()[by_name], x)
    return run


def average(words: pa.Table) -> pa.Table:
    """One row per word: the mean of its vectors, by their occurrences."""
    name = words["word"].combine_chunks().dictionary_encode()
    code, here = np.asarray(name.indices), words["here"].to_numpy()
    vecs = words["vec"].combine_chunks()
    x = vecs.flatten().to_numpy().reshape(len(vecs), -1)
    order = np.lexsort((here, code))
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    n = np.add.reduceat(here[order], first)
    out = np.empty((len(first), x.shape[1]), np.float32)
    for j in range(x.shape[1]):  # a column at a time: no second copy of all vectors
        out[:, j] = np.add.reduceat(x[order, j] * here[order].astype(np.float64), first) / n
    return _table(name.dictionary.take(pa.array(code[order[first]])), n, out)


def _table(words: pa.Array, here: np.ndarray, x: np.ndarray) -> pa.Table:
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int64) * x.shape[1], pa.int32())
    return pa.table({"word": words.cast(pa.string()), "here": pa.array(here, pa.int64()),
                     "vec": pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel(), pa.float32()))})
