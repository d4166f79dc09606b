"""Elias-Fano sequences and trie levels in flat buffers.

A sequence of n non-decreasing numbers below u keeps the low ``log2(u / n)``
bits of each number side by side and the high parts as one bit per number and
one per possible high part.  A level of an n-gram trie has three of them and
a byte per child:

* the contexts, numbers of the nodes of the level above;
* the monotone pointers to each context's first child;
* the children's words, each raised by the sum of the contexts before (so the
  whole is monotone, and a word is searched relative to its context);
* the quantised probability of each child.

Both are views of a buffer: an Arrow buffer, bytes or a mapped file; nothing
is copied to be opened.  Lookups work on whole arrays.
"""

from __future__ import annotations

import mmap

import numpy as np

_U = np.uint64


def _low_bits(n: int, top: int) -> int:
    return max(int(top // max(n, 1)).bit_length() - 1, 0)


class EliasFano:
    """``n`` numbers; see the module."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self._ones: np.ndarray | None = None
        self._zeros: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(_U)
        n = len(v)
        bits = _low_bits(n, int(v[-1]) + 1 if n else 1)
        low = np.zeros(n * bits // 64 + 2, _U)
        if bits and n:
            at = np.arange(n, dtype=_U) * _U(bits)
            word, off, part = (at >> _U(6)).astype(np.int64), at & _U(63), v & _U((1 << bits) - 1)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[first]] += np.add.reduceat(part << off, first)  # disjoint bits: a sum is an or
            low[word[first] + 1] += np.add.reduceat((part >> _U(1)) >> (_U(63) - off), first)
        up = (v >> _U(bits)).astype(np.int64)
        flags = np.zeros(n + (int(up[-1]) if n else 0) + 2, np.uint8)
        flags[up + np.arange(n)] = 1
        return cls(n, bits, low, np.packbits(flags))

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high]

    def _positions(self) -> np.ndarray:
        if self._ones is None:
            bits = np.unpackbits(self.high)
            self._ones = np.flatnonzero(bits)
            # zero h ends the numbers with high part h
            self._zeros = np.flatnonzero(bits[:self._ones[-1] + 2 if self.n else 1] == 0)
        return self._ones

    def _before(self, up: np.ndarray) -> np.ndarray:
        """How many numbers have a high part below ``up``."""
        self._positions()
        last = np.minimum(up, len(self._zeros)) - 1
        return np.where(up > 0, self._zeros[np.maximum(last, 0)] - last, 0)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i.astype(_U) * _U(self.bits)
        word, off = (at >> _U(6)).astype(np.int64), at & _U(63)
        both = (self.low[word] >> off) | ((self.low[word + 1] << _U(1)) << (_U(63) - off))
        return both & _U((1 << self.bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._positions()[i] - i).astype(_U) << _U(self.bits)) | self._lows(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first number not below ``x`` (``n`` if there is none)."""
        x = np.asarray(x).astype(_U)
        up, part = (x >> _U(self.bits)).astype(np.int64), x & _U((1 << self.bits) - 1)
        lo, hi = self._before(up), self._before(up + 1)
        open_ = np.flatnonzero(lo < hi)
        while open_.size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < part[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo


class Level:
    """A level of the trie; ``find`` is its only lookup."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, words: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.words, self.codes = contexts, pointers, words, codes

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, code: np.ndarray) -> Level:
        """From children by context, then word, each once; words are positive."""
        first = np.flatnonzero(np.diff(context, prepend=-1)) if len(context) else np.empty(0, np.int64)
        sizes = np.diff(np.append(first, len(context)))
        tops = word[first + sizes - 1] if len(first) else np.empty(0, np.int64)
        before = np.concatenate([[0], np.cumsum(tops)])[:-1] if len(first) else np.empty(0, np.int64)
        return cls(EliasFano.of(context[first]), EliasFano.of(np.append(first, len(context))),
                   EliasFano.of(word + np.repeat(before, sizes)), code.astype(np.uint8))

    def to_bytes(self) -> bytes:
        """One flat buffer: a table of sizes, then the parts, on 8-byte borders."""
        parts = [p for s in (self.contexts, self.pointers, self.words) for p in s.parts()] + [self.codes]
        raw = [p.tobytes() for p in parts]
        head = np.array([len(r) for r in raw], np.int64).tobytes()
        return head + b"".join(r + bytes(-len(r) % 8) for r in raw)

    @classmethod
    def view(cls, buffer) -> Level:
        """The level in a buffer, without a copy."""
        sizes = np.frombuffer(buffer, np.int64, 10)
        at, parts = 80, []
        for k, size in enumerate(sizes.tolist()):
            kind = np.uint8 if k in (2, 5, 8, 9) else (_U if k in (1, 4, 7) else np.int64)
            parts.append(np.frombuffer(buffer, kind, size // np.dtype(kind).itemsize, at))
            at += size + -size % 8
        seq = [EliasFano(int(parts[k][0]), int(parts[k][1]), parts[k + 1], parts[k + 2]) for k in (0, 3, 6)]
        return cls(*seq, parts[9])

    @classmethod
    def map(cls, path: str) -> Level:
        """The level in a file, memory-mapped."""
        with open(path, "rb") as f:
            return cls.view(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The child's place in the level for every (context, word), -1 without one."""
        out = np.full(len(context), -1, np.int64)
        if not self.contexts.n or not len(out):
            return out
        # one search per stretch of queries with the same context
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        asked = context[first]
        node = self.contexts.successor(asked)
        there = node < self.contexts.n
        there[there] = self.contexts[node[there]] == asked[there].astype(_U)
        node = np.where(there, node, 0)
        begin, end = (self.pointers[node + d].astype(np.int64) for d in (0, 1))
        raised = np.zeros(len(asked), _U)  # what the contexts before raised this one's words by
        later = begin > 0
        raised[later] = self.words[begin[later] - 1]
        sizes = np.diff(np.append(first, len(context)))
        known = np.flatnonzero(np.repeat(there, sizes))
        lo, hi, base = (np.repeat(x, sizes)[known] for x in (begin, end, raised))
        wanted = base + word[known].astype(_U)
        child = self.words.successor(wanted)
        inside = (child >= lo) & (child < hi)
        inside[inside] = self.words[child[inside]] == wanted[inside]
        out[known[inside]] = child[inside]
        return out
