"""Quality classifier: random Fourier features over document statistics.

Every whole text becomes a short vector of statistics (lengths, character
classes, repetition of words, lines and neighbours).  Random Fourier features
of the standardised vector approximate a Gaussian kernel; ridge regression on
them is fitted from normal equations that every partition sums on its own and
that are then added row by row; isotonic regression on labelled rows that the
ridge fit has not seen turns its scores into probabilities.

The driver holds the summed equations (``N_FEATURES`` squared), means of the
statistics and ``CALIBRATION_BINS`` counts, whatever the size of the corpus.
All labelled rows outside the held-out fold are used; there is no sample.

Defined cases: a null text is empty and is scored like an empty one; labels
that are null or have no document are left out, of a document labelled
several times every label counts; a null id belongs to no fold (``held_out``
is null), carries no label and is scored; with labels of one value only, or
none, every score is that share (0.5 without labels); an empty table gives
no rows.  Other columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import documents, fresh_names, stage, text_of
from tidings.session import read_table

N_FEATURES = 384
RIDGE = 1e-3
CALIBRATION_BINS = 2048
THRESHOLD = 0.3
N_FOLDS = 5
#: Groups in which the partitions' sums are added first.
SUM_GROUPS = 64
STATS = ("chars", "words", "word_chars", "long_words", "short_words", "upper", "digits", "symbols", "marks",
         "other_bytes", "lines", "line_copies", "distinct_words", "same_neighbours", "lone_symbols",
         "byte_entropy", "top_word")
_MARKS = np.frombuffer(b".,;:!?'\"()-", np.uint8)


def statistics(text: str) -> list[float]:
    """The statistics of one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
    n = max(1.0, counts.sum())
    space = counts[[9, 10, 11, 12, 13, 32]].sum()
    upper, digits, lower = counts[65:91].sum(), counts[48:58].sum(), counts[97:123].sum()
    marks, high = counts[_MARKS].sum(), counts[128:].sum()
    words = data.split()
    k = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lines = data.split(b"\n")
    bag: dict[bytes, int] = {}
    for w in words:
        bag[w] = bag.get(w, 0) + 1
    p = counts[counts > 0] / n
    return [np.log1p(len(data)), np.log1p(len(words)), float(sizes.sum()) / k,
            float((sizes > 14).sum()) / k, float((sizes < 3).sum()) / k,
            upper / n, digits / n, (n - space - upper - digits - lower - marks - high) / n, marks / n, high / n,
            len(lines) / n, 1 - len(set(lines)) / len(lines),
            len(bag) / k ** 0.85, sum(a == b for a, b in zip(words, words[1:])) / k,
            sum(not w.isalnum() and len(w) == 1 and w < b"\x80" for w in words) / k,
            float(-(p * np.log2(p)).sum()) if len(data) else 0.0,
            max(bag.values(), default=0) / k]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``stats`` of every document, written once."""
    def run(batches):
        for b in batches:
            rows = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))],
                                             names=["doc_id", "stats"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return stage(rows.mapInArrow(run, "doc_id long, stats array<double>"), "quality-stats")


def fold(id_col: str = "doc_id", n: int = N_FOLDS) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


@dataclass
class Model:
    """Everything a score needs, of a fixed size."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: np.ndarray
    level: np.ndarray
    seed: int = 5

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        d = len(self.mean)
        w = rng.normal(size=(d, N_FEATURES)) / np.sqrt(d)
        shift = rng.uniform(0, 2 * np.pi, N_FEATURES)
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / N_FEATURES) * np.cos(x @ w + shift)
        return np.hstack([z, x, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.cut):
            return np.full(len(stats), self.level[0])
        return np.round(np.interp(self.raw(stats), self.cut, self.level), 6)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _normal_equations(labelled: DataFrame, model: Model) -> np.ndarray:
    """Sum of z z' and z y: every partition adds up its own rows; then row i of
    the partitions' matrices is added in ``SUM_GROUPS`` groups, and over these."""
    def partial(batches):
        total = None
        for b in batches:
            z = model.features(_matrix(b.column(0)))
            zy = np.hstack([z, b.column(1).to_numpy()[:, None].astype(float)])
            total = z.T @ zy if total is None else total + z.T @ zy
        if total is not None:
            group = TaskContext.get().partitionId() % SUM_GROUPS
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()),
                                              pa.array([group] * len(total), pa.int32()),
                                              pa.array([r.tobytes() for r in total], pa.binary())],
                                             names=["i", "g", "part"])

    def add(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table["part"].to_pylist())).reshape(table.num_rows, -1)
        return pa.table({"i": table["i"][:1], "g": table["g"][:1],
                         "part": pa.array([np.sort(rows, axis=0).sum(axis=0).tobytes()], pa.binary())})
    schema = "i int, g int, part binary"
    sums = labelled.select("stats", "label").mapInArrow(partial, schema)
    rows = sums.groupBy("i", "g").applyInArrow(add, schema).groupBy("i").applyInArrow(add, schema).collect()
    return np.stack([np.frombuffer(r.part) for r in sorted(rows, key=lambda r: r.i)])


def isotonic(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means closest to total / count."""
    blocks: list[list[float]] = []
    for t, c in zip(total, count):
        blocks.append([t, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, c2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + c2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), t / c) for t, c, k in blocks]) if blocks else np.zeros(0)


def _calibration(labelled: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Label counts per bin of the raw score, then isotonic levels at the bins' means."""
    def run(batches):
        for b in batches:
            raw = model.raw(_matrix(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(raw), b.column(1).cast(pa.float64())], names=["raw", "label"])
    edge = F.least(F.greatest((F.col("raw") + 0.5) / 2, F.lit(0.0)), F.lit(1.0))
    bins = (labelled.select("stats", "label").mapInArrow(run, "raw double, label double")
            .groupBy(F.floor(edge * (CALIBRATION_BINS - 1)).alias("bin"))
            .agg(F.avg("raw").alias("raw"), F.sum("label").alias("total"), F.count(F.lit(1)).alias("n"))
            .orderBy("bin").collect())
    total, n = np.array([r.total for r in bins]), np.array([r.n for r in bins], float)
    cut = np.maximum.accumulate(np.array([r.raw for r in bins]))
    # one half-weighted row of either label at the ends keeps scores off 0 and 1
    if len(total):
        total[-1], n[-1], n[0] = total[-1] + 0.5, n[-1] + 0.5, n[0] + 0.5
    return cut, isotonic(total, n)


def fit(stats: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    """``labels`` has ``doc_id`` and ``target``; the held-out fold is left out.
    Means and deviations are taken over all documents."""
    d = len(STATS)
    moments = stats.agg(*[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(d)
                          for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(d)])
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
    labelled = stage(stats.where(fold() != 0).join(labels.where("label is not null"), "doc_id"), "quality-train")
    tally = labelled.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share")).first()
    model = Model(mean, scale, np.zeros(0), np.zeros(0), np.array([0.5 if tally.share is None else tally.share]))
    if not tally.n or tally.share in (0.0, 1.0):
        return model
    second = F.pmod(F.crc32(F.concat(F.lit("calibrate"), F.col("doc_id").cast("string")).cast("binary")), F.lit(4)) == 0
    sums = _normal_equations(labelled.where(~second), model)
    if len(sums):
        a, y = sums[:, :-1], sums[:, -1]
        model.weights = np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) / 100 * np.eye(len(a)), y)
        cut, level = _calibration(labelled.where(second), model)
        if len(cut):
            model.cut, model.level = cut, level
    return model


def score_statistics(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))],
                                             names=["doc_id", "score"])
    return (stats.mapInArrow(run, "doc_id long, score double")
            .select("doc_id", (fold() == 0).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    stats = document_statistics(docs)
    return score_statistics(stats, fit(stats, labels))


def kept_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without those predicted to be of low quality; texts are scored
    where they lie and never shuffled."""
    model = fit(document_statistics(docs), labels)
    tmp, = fresh_names(docs, "_text")
    cols = docs.columns

    def run(batches):
        for b in batches:
            if b.num_rows:
                stats = np.array([statistics(t.as_py()) for t in b.column(len(cols))])
                yield b.select(cols).filter(pa.array(model.score(stats) >= THRESHOLD))
    return docs.withColumn(tmp, text_of(text_col)).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
