"""Incremental corpus build: Structured Streaming over the landing zone.

New crawler files (JSON Lines records) are picked up by ``readStream``,
cleaned with the same row-local expressions as the batch build, and each
micro-batch is appended to the corpus table with ids after the current
maximum (``append_news``), in a folder named by its epoch: an epoch that is run
again after a failure overwrites its own rows.  The stream checkpoint lives in
the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import clean as CL
from ..session import scratch_path
from ..sources.io import append_news


def clean_records(raw: DataFrame) -> DataFrame:
    """Row-local part of the corpus build (CLN1-CLN6)."""
    return raw.select(
        "link",
        CL.norm_unicode(CL.norm_space(CL.html_to_text("text"))).alias("text"),
        CL.norm_unicode(CL.norm_space("title")).alias("title"),
        "source",
        CL.clamp_epoch(CL.parse_iso("timestamp")).alias("timestamp"),
        CL.resolve_urls("link", F.coalesce("refers_to", F.array().cast("array<string>"))).alias("refers_to"))


def stream_corpus(spark: SparkSession, landing_dir: str, table_path: str, checkpoint: str | None = None,
                  glob: str = "*.json", available_now: bool = True):
    """Start the incremental build; returns the StreamingQuery."""
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    raw = (spark.readStream.schema(schemas.RAW_NEWS).option("recursiveFileLookup", "true")
           .option("pathGlobFilter", glob).json(landing_dir))
    cleaned = clean_records(raw)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        append_news(batch, table_path, spark, batch=epoch_id)

    w = cleaned.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
