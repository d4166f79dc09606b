"""Exact deduplication against a persistent digest index.

The index is a table with one row per distinct text, bucketed and sorted by
the text's SHA-256.  A batch is reduced to one row per digest (partial
aggregation, so a text that makes up a third of the batch costs one row per
task), sort-merge anti-joined with the index, whose buckets are read as they
lie, and what is new is appended to the same buckets.

Defined cases: a null text is the empty text, equal to other empty texts; a
null id counts as smaller than any other; of rows with equal text and equal
id exactly one stays; an empty table adds nothing and returns no row.  Only
the id and text columns are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import LONG_MIN, documents, join_per_key, keep_rows, stage, text_of


def text_digest(text_col: str = "text") -> Column:
    """SHA-256 of the unchanged text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(text_of(text_col).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, each with the document that stands for it.

    With a ``path`` the index is a table of that folder, which a later
    application opens by the same path: the number of buckets is kept beside
    it, and a table that the catalog does not know is registered again."""

    _COLUMNS = "digest BINARY, keep_id BIGINT, keep_row BIGINT, delivery STRING"

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.table, self.path = spark, table, path and path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if self.path and not self.exists():
            try:
                self.buckets = spark.read.schema("buckets int").json(f"{self.path}_buckets").first()["buckets"]
            except AnalysisException:  # there is no such folder: a new index
                spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.json(f"{self.path}_buckets")
                return
            spark.sql(f"CREATE TABLE {table} ({self._COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                      f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        """Forget the index; without a path its rows are deleted too."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def ingest(self, batch: DataFrame, delivery: str = "") -> None:
        """Append the digests of ``batch`` (``row``, ``id``, ``digest``) that
        the index has not, with the ``delivery`` that brought them; of a batch's
        equal digests the largest id stays."""
        new = (batch.groupBy("digest")
               .agg(F.max("id").alias("keep_id"), F.max_by("row", "id").alias("keep_row"))
               .repartition(self.buckets, "digest"))
        if self.exists():
            new = new.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        write = (new.select("digest", "keep_id", "keep_row", F.lit(delivery).alias("delivery")).write.mode("append")
                 .format("parquet").bucketBy(self.buckets, "digest").sortBy("digest"))
        (write.option("path", self.path) if self.path else write).saveAsTable(self.table)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (any unique number), ``id`` (null as the smallest long) and
    ``digest`` of every document, written once: texts are read a single time."""
    return stage(docs.select(F.monotonically_increasing_id().alias("row"),
                             F.coalesce(F.col(id_col).cast("long"), F.lit(LONG_MIN)).alias("id"),
                             text_digest(text_col).alias("digest")), "digests")


def resolve(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """Every row of ``rows`` with the row, id and delivery that stay for its text."""
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    stats = stage(index.read().join(sizes, "digest"), "digest-groups")
    return join_per_key(rows, stats, "digest", "group_size", rows.count())


def fresh_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id",
                text_col: str = "text", batches: int = 2) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``.

    The documents enter the index in ``batches`` parts by falling id, as new
    deliveries would, so that across batches too the largest id stays.  With
    an ``index`` of earlier deliveries, documents that it holds are not kept.
    """
    own, index = index is None, index or fresh_index(docs.sparkSession)
    delivery = uuid.uuid4().hex
    rows = digest_rows(docs, id_col, text_col)
    span = rows.agg(F.min(F.nullif("id", F.lit(LONG_MIN))).alias("lo"), F.max("id").alias("hi")).first()
    hi = span["hi"] if span["hi"] is not None else 0
    lo = span["lo"] if span["lo"] is not None else hi
    cuts = [hi - (hi - lo + 1) * k // batches for k in range(1, batches)]
    for k in range(batches):
        part = rows
        if k:
            part = part.where(F.col("id") <= F.lit(cuts[k - 1]))
        if k < batches - 1:
            part = part.where(F.col("id") > F.lit(cuts[k]))
        index.ingest(part, delivery)
    as_id = lambda c: F.nullif(c, F.lit(LONG_MIN))
    resolved = resolve(rows, index)  # from written tables: the index is no longer needed
    if own:
        index.drop()
    return resolved.select(
        as_id("id").alias("doc_id"), as_id("keep_id").alias("keep_id"), "group_size",
        ((F.col("row") == F.col("keep_row")) & (F.col("delivery") == delivery)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   index: DigestIndex | None = None) -> DataFrame:
    """``docs`` without the rows whose text another row stands for."""
    fresh, index = index is None, index or fresh_index(docs.sparkSession)
    delivery = uuid.uuid4().hex
    rows = digest_rows(docs, id_col, text_col)
    index.ingest(rows, delivery)
    same = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("same"))
    own = index.read().where(F.col("delivery") == delivery)
    kept = stage(own.select("digest", F.col("keep_id").alias("id")).join(same, ["digest", "id"])
                 .select("id", F.col("digest").alias("key"), "same"), "digest-kept")
    if fresh:
        index.drop()
    return keep_rows(docs, kept, id_col, text_digest(text_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
