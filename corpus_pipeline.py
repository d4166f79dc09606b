"""The corpus pipeline: quality, exact copies, near copies, mixture, packing.

Every stage takes the documents that the one before it kept and calls one
operator of ``tidings.llm``; all but the last return the columns of
``documents``, the last the packed pieces.

Defined cases: a null text counts as empty and stays null until a copy or the
mix removes it; documents without words are not in the mix, so they are not
packed; of rows equal in id and text one stays; null ids and sources are kept; of equal
texts the largest id stays, of near copies the smallest; without labels nothing
is rejected; empty tables give no rows; more columns, whatever their names, pass
all stages but the last; long texts are never cut before the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidings.llm import exact_dedup, mixing, packing, quality, simhash
from tidings.llm.common import documents, stage
from tidings.session import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.kept_documents(docs, read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.kept_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.kept_documents(docs, shingle=4, max_bits=4)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every document and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage),
          ("SimHash near-dedup", near_stage), ("mixing", mixing_stage), ("best-fit packing", packing_stage)]

#: Classifier, components and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, fn) in enumerate(STAGES):
        docs = fn(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"stage{i}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
