"""CLU3: micro-clusters by clustering-feature trees (Birch, Zhang et al. 1996).

A feature (n, linear sum, square sum) stands for a set of points; features of
disjoint sets add up, and the radius (RMS distance from the mean) follows from
them.  Every partition puts its points into a tree of bounded nodes: down the
nearest means to a leaf entry, which takes the point if its radius stays
within the bound, else a new entry is made; a full node is split around its two
entries farthest apart.  A tree with ``ENTRIES`` entries is given out and begun
anew, so a task's memory is bounded by entries and not by points.

Entries are then merged level by level, as points with weights: those near the
same pivot entry meet in a tree of their own, in groups of bounded size, until
a level no longer makes them fewer.  A point only remembers its first entry;
which entry took it in is followed through the levels at the end.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import join_counted

ENTRIES = 4096
#: Entries of a tree's node.
BRANCHES = 32
#: A level that leaves more than this share of the entries is the last.
SHARE = 0.9

_FEATURES = "entry long, n long, ls array<double>, ss double, first long"


class _Node:
    """Up to ``BRANCHES`` features, each an entry (leaf) or a node below."""

    def __init__(self, dims: int, leaf: bool):
        self.leaf, self.size = leaf, 0
        self.n, self.ss = np.zeros(BRANCHES + 1), np.zeros(BRANCHES + 1)
        self.ls = np.zeros((BRANCHES + 1, dims))
        self.below: list = []

    def add(self, n, ls, ss, below) -> None:
        self.n[self.size], self.ls[self.size], self.ss[self.size] = n, ls, ss
        self.below.append(below)
        self.size += 1

    def means(self) -> np.ndarray:
        return self.ls[:self.size] / self.n[:self.size, None]

    def total(self):
        k = self.size
        return self.n[:k].sum(), self.ls[:k].sum(0), self.ss[:k].sum()

    def split(self) -> tuple[_Node, _Node]:
        m = self.means()
        d = (m * m).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2 * m @ m.T
        a, b = np.unravel_index(d.argmax(), d.shape)
        halves = _Node(self.ls.shape[1], self.leaf), _Node(self.ls.shape[1], self.leaf)
        to_b = d[b] < d[a]
        to_b[a], to_b[b] = False, True
        for i in range(self.size):
            halves[int(to_b[i])].add(self.n[i], self.ls[i], self.ss[i], self.below[i])
        return halves


class Tree:
    """Entries whose radius is at most ``r``; ``insert`` names the one that took a feature."""

    def __init__(self, dims: int, r: float):
        self.root, self.r2, self.entries = _Node(dims, True), r * r, 0

    def insert(self, n, ls, ss) -> int:
        taken, halves = self._into(self.root, n, ls, ss)
        if halves:
            root = _Node(len(ls), False)
            for h in halves:
                root.add(*h.total(), h)
            self.root = root
        return taken

    def _into(self, node: _Node, n, ls, ss):
        j = int((((node.means() - ls / n) ** 2).sum(1)).argmin()) if node.size else 0
        if node.leaf:
            if node.size:
                total = node.n[j] + n
                mean = (node.ls[j] + ls) / total
                if (node.ss[j] + ss) / total - mean @ mean <= self.r2:
                    node.n[j], node.ss[j] = total, node.ss[j] + ss
                    node.ls[j] += ls
                    return node.below[j], None
            taken, self.entries = self.entries, self.entries + 1
            node.add(n, ls, ss, taken)
        else:
            taken, halves = self._into(node.below[j], n, ls, ss)
            if not halves:
                node.n[j], node.ss[j] = node.n[j] + n, node.ss[j] + ss
                node.ls[j] += ls
                return taken, None
            one, two = halves
            node.n[j], node.ls[j], node.ss[j] = one.total()
            node.below[j] = one
            node.add(*two.total(), two)
        return taken, node.split() if node.size > BRANCHES else None

    def leaves(self):
        """(entry, n, ls, ss) of every entry."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            for i in range(node.size):
                if node.leaf:
                    yield node.below[i], int(node.n[i]), node.ls[i].tolist(), float(node.ss[i])
                else:
                    stack.append(node.below[i])


def first_entries(points: DataFrame, r: float, limit: int = ENTRIES) -> DataFrame:
    """Points (id, vec) in trees, one after the other per partition: rows (id,
    entry) of the points and rows (entry, n, ls, ss, first) of the entries,
    told apart by ``id``; ``first`` is the smallest id of an entry."""
    def run(batches):
        base, made, tree, first = TaskContext.get().partitionId() << 40, 0, None, {}

        def give_out():
            nonlocal tree, made, first
            rows = [(None, base + made + e, n, ls, ss, first[e]) for e, n, ls, ss in tree.leaves()]
            made, tree, first = made + tree.entries, None, {}
            return pd.DataFrame(rows, columns=["id", "entry", "n", "ls", "ss", "first"])

        for pdf in batches:
            out = []
            for i, v in zip(pdf["id"].tolist(), pdf["vec"]):
                x = np.asarray(v, np.float64)
                if tree is None:
                    tree = Tree(len(x), r)
                e = tree.insert(1, x, float(x @ x))
                first[e] = min(first.get(e, i), i)
                out.append((i, base + made + e, None, None, None, None))
                if tree.entries >= limit:
                    yield pd.DataFrame(out, columns=["id", "entry", "n", "ls", "ss", "first"])
                    out = []
                    yield give_out()
            if out:
                yield pd.DataFrame(out, columns=["id", "entry", "n", "ls", "ss", "first"])
        if tree is not None:
            yield give_out()
    return points.select("id", "vec").mapInPandas(run, "id long, " + _FEATURES)


def merge_level(entries: DataFrame, r: float, limit: int = ENTRIES) -> DataFrame:
    """Entries merged among those near the same pivot: rows (old, entry) and,
    where ``old`` is null, the merged entries.  A merged entry has the number of the
    first that came."""
    n = entries.count()
    cells = max(1, math.ceil(n / limit))
    picked = entries.orderBy(F.xxhash64("entry", F.lit(n)), "entry").limit(min(cells, ENTRIES)).collect()
    piv = np.stack([np.asarray(p["ls"]) / p["n"] for p in picked])

    def near(batches):
        for pdf in batches:
            if len(pdf):
                m = np.stack([np.asarray(x) for x in pdf["ls"]]) / pdf["n"].to_numpy()[:, None]
                d = (m * m).sum(1)[:, None] + (piv * piv).sum(1)[None, :] - 2 * m @ piv.T
                yield pdf.assign(cell=d.argmin(axis=1))

    placed = entries.mapInPandas(near, _FEATURES + ", cell long")
    size = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_c"))
    placed = join_counted(placed, size, "cell", "_c", n).withColumn(
        "part", F.pmod(F.xxhash64("entry"), F.ceil(F.col("_c") / limit)))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "entry"], ascending=[False, True])
        tree, number, first, rows = None, {}, {}, []
        for e, k, ls, ss, f in zip(*(pdf[c] for c in ("entry", "n", "ls", "ss", "first"))):
            x = np.asarray(ls, np.float64)
            tree = tree or Tree(len(x), r)
            t = tree.insert(k, x, ss)
            number.setdefault(t, e)
            first[t] = min(first.get(t, f), f)
            rows.append((e, number[t], None, None, None, None))
        rows += [(None, number[t], k, ls, ss, first[t]) for t, k, ls, ss in tree.leaves()]
        return pd.DataFrame(rows, columns=["old", "entry", "n", "ls", "ss", "first"])
    return placed.groupBy("cell", "part").applyInPandas(merge, "old long, " + _FEATURES)


def cluster_micro(vecs: DataFrame, r: float = 0.5, id_col: str = "id", vec: str = "vec",
                  limit: int = ENTRIES) -> tuple[DataFrame, DataFrame]:
    """Micro-clusters whose radius is at most ``r``: assignment (id, label) and
    summaries (label, n, ls, ss, center, radius); labels are the smallest member id."""
    rows = cut_lineage(first_entries(vecs.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("vec")), r, limit))
    points = rows.where("id is not null").select("id", "entry")
    entries = rows.where("id is null").drop("id")
    home = entries.select("entry", F.col("entry").alias("now"))  # first entry -> entry of the last level
    size = entries.select("entry", "n")
    left = entries.count()
    while left > 1:
        level = cut_lineage(merge_level(entries, r, limit))
        moved = level.where("old is not null").select(F.col("old").alias("now"), F.col("entry").alias("_new"))
        home = cut_lineage(home.join(moved, "now").select("entry", F.col("_new").alias("now")))
        entries = level.where("old is null").drop("old")
        before, left = left, entries.count()
        if left > SHARE * before:
            break
    center = F.transform("ls", lambda x: x / F.col("n"))
    square = F.aggregate(center, F.lit(0.0), lambda acc, x: acc + x * x)
    summaries = entries.select(F.col("first").alias("label"), "n", "ls", "ss", center.alias("center"),
                               F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - square)).alias("radius"))
    named = home.join(entries.select(F.col("entry").alias("now"), F.col("first").alias("label")), "now").join(size, "entry")
    return join_counted(points, named.select("entry", "label", "n"), "entry", "n", points.count()).select("id", "label"), summaries
