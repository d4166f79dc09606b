"""Sources and sinks (SRC1-SRC15).  Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.clean import clamp_epoch, parse_iso, to_iso, validate_news, with_dense_id
from ..session import scratch_path
from .wrapped import can_open, read_whole, read_wrapped

LONG_MIN = -(2 ** 63)


def _scratch(spark: SparkSession, name: str, path: str | None) -> str:
    return path or scratch_path(spark, name)


# SRC1 -----------------------------------------------------------------------
def read_news(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines corpus with ISO timestamps -> NEWS rows (id kept if present)."""
    sch = T.StructType([*schemas.RAW_NEWS.fields, T.StructField("id", T.LongType())])
    raw = spark.read.schema(sch).json(path)
    return raw.select("id", "link", "text", "title", "source",
                      parse_iso("timestamp").alias("timestamp"), "refers_to")


# SRC2 -----------------------------------------------------------------------
def scan_mixed_json(spark: SparkSession, root: str, lines_glob: str = "*.jsonl",
                    whole_glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """All ``*.jsonl`` (one record per line) and ``*.json`` files below root,
    as (records, quarantine).

    A ``.json`` file whose object wraps a list of records gives its elements,
    read step by step (``wrapped.read_wrapped``); any other object with several
    keys is one record.  Lines and files that are no JSON object, and what
    stands in or behind a wrapped list without being a record, go to the
    quarantine with their path and content."""
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", lines_glob).text(root)
             .select(F.col("_metadata.file_path").alias("path"), "value").where(F.trim("value") != ""))
    is_line = F.json_object_keys("value").isNotNull()
    read = read_wrapped if can_open(root) else read_whole
    found = lines.select("path", F.when(is_line, "record").otherwise("broken").alias("kind"), "value").unionByName(
        read(spark, root, whole_glob))
    records = found.where("kind = 'record'").select(F.from_json("value", schemas.RAW_NEWS).alias("r")).select("r.*")
    return records, found.where("kind = 'broken'").select("path", "value")


def read_mixed_json(spark: SparkSession, root: str, lines_glob: str = "*.jsonl",
                    whole_glob: str = "*.json") -> DataFrame:
    """The records of ``scan_mixed_json``."""
    return scan_mixed_json(spark, root, lines_glob, whole_glob)[0]


# SRC3 -----------------------------------------------------------------------
def write_news(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON Lines, UTF-8 (non-ASCII kept), timestamps as ISO strings."""
    out = df.withColumn("timestamp", to_iso(clamp_epoch("timestamp")))
    out.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


# SRC4 -----------------------------------------------------------------------
def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(schemas.TAXONOMY).option("header", "true")
            .option("multiLine", "true").option("escape", '"')
            .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))


def write_taxonomy(df: DataFrame, path: str) -> str:
    df.select("Kod", "Name", "SectionName", "Notes").write.mode("overwrite") \
        .option("header", "true").option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return path


# SRC5 -----------------------------------------------------------------------
def write_csv_by_date(df: DataFrame, path: str, ts_col: str = "timestamp") -> str:
    """One folder per calendar day (partition pruning on read)."""
    (df.withColumn("date", F.to_date(F.col(ts_col))).hint("rebalance", "date").write.mode("overwrite")
       .partitionBy("date").option("header", "true").csv(path))
    return path


# SRC6 -----------------------------------------------------------------------
def write_code_map(codes: DataFrame, path: str, id_col: str = "news_id", okveds_col: str = "okveds") -> str:
    """One JSON object per line: {"<id>": ["NN.N", ...]}."""
    obj = F.to_json(F.create_map(F.col(id_col).cast("string"), F.col(okveds_col)))
    codes.select(obj.alias("value")).write.mode("overwrite").text(path)
    return path


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """Key -> array JSON objects (one per line, or one object for the whole
    map) -> bridge (news_id, okved)."""
    m = spark.read.text(path).select(
        F.from_json("value", T.MapType(T.StringType(), T.ArrayType(T.StringType()))).alias("m"))
    kv = m.select(F.explode("m").alias("k", "v"))
    return kv.select(F.col("k").cast("long").alias("news_id"), F.explode("v").alias("okved"))


# SRC7 / SRC15 ------------------------------------------------------------------
def write_citations(suits_df: DataFrame, spark: SparkSession | None = None, path: str | None = None,
                    return_path: bool = False):
    """(link, suits[]) as JSON Lines; returns the read-back frame (or path)."""
    spark = spark or suits_df.sparkSession
    path = _scratch(spark, "citations", path)
    suits_df.select("link", "suits").write.mode("overwrite").json(path)
    return path if return_path else spark.read.schema(schemas.CITATION_ROW).json(path)


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    """link -> suits[] rows -> edge table (cited_link, citing_link); a link
    without citing articles keeps one row with a NULL citing link."""
    rows = spark.read.schema(schemas.CITATION_ROW).json(path)
    return rows.select(F.col("link").alias("cited_link"), F.explode_outer("suits").alias("citing_link"))


# SRC8 -----------------------------------------------------------------------
def read_roles(spark: SparkSession, path: str) -> DataFrame:
    """{role: {sources: [...], add_okveds: [...]}} -> (role, sources, add_okveds)."""
    txt = spark.read.option("wholetext", "true").text(path)
    m = txt.select(F.from_json("value", T.MapType(T.StringType(), schemas.ROLE)).alias("m"))
    return m.select(F.explode("m").alias("role", "cfg")).select("role", "cfg.sources", "cfg.add_okveds")


def write_roles(roles: DataFrame, path: str) -> str:
    obj = roles.agg(F.to_json(F.map_from_entries(F.collect_list(
        F.struct("role", F.struct("sources", "add_okveds"))))).alias("value"))
    obj.coalesce(1).write.mode("overwrite").text(path)
    return path


# Related-code map (JN4) -------------------------------------------------------
def read_related_codes(spark: SparkSession, path: str) -> DataFrame:
    """{code: [related codes]} objects, one per line -> edges (okved, related).
    Codes are normalised: blanks dropped, one-digit sections padded, a final
    full stop dropped."""
    m = spark.read.text(path).select(
        F.from_json("value", T.MapType(T.StringType(), T.ArrayType(T.StringType()))).alias("m"))
    kv = m.select(F.explode("m").alias("k", "v")).select("k", F.explode("v").alias("v"))

    def normal(c):
        x = F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"\.$", "")
        return F.regexp_replace(x, r"^([0-9])(\.|$)", "0$1$2")
    return kv.select(normal(F.col("k")).alias("okved"), normal(F.col("v")).alias("related")).where(
        "okved <> '' and related <> ''").distinct()


# SRC9 -----------------------------------------------------------------------
def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# SRC10 ----------------------------------------------------------------------
def write_vectors(data_cells: DataFrame, centers: DataFrame, nlist: int, nprobe: int, dims: int, path: str) -> str:
    """Vectors partitioned by cell (a probe reads only its cells), the cells'
    centres and radii and a one-row parameter table.  Rows are rebalanced by cell first:
    few files per cell, and a large cell is split over several tasks."""
    (data_cells.select("id", "vec", "cell").hint("rebalance", "cell").write.mode("overwrite")
     .partitionBy("cell").parquet(f"{path}/vectors"))
    centers.write.mode("overwrite").parquet(f"{path}/centers")
    spark = data_cells.sparkSession
    spark.createDataFrame([(nlist, nprobe, dims)], "nlist long, nprobe long, dims long") \
        .write.mode("overwrite").parquet(f"{path}/params")
    return path


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors with their cell, centres, parameters)."""
    vecs = spark.read.parquet(f"{path}/vectors").withColumn("cell", F.col("cell").cast("long"))
    return vecs, spark.read.parquet(f"{path}/centers"), spark.read.parquet(f"{path}/params")


# SRC11 ----------------------------------------------------------------------
def stored_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the ``batch=<number>`` folders; none when there is no table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return [int(x[6:]) for x in names if x.startswith("batch=")]


def append_news(new_rows: DataFrame, table_path: str, spark: SparkSession | None = None,
                batch: int | None = None) -> DataFrame:
    """Validate, give ids after the current maximum, append; returns the
    stored rows (with ids).

    Every append is a folder of its own, ``batch=<number>``, written in
    overwrite mode: a batch that is written again (a replayed epoch) takes its
    former place and the ids after the batches before it.  Invalid rows go to
    ``<table>_rejected`` in the same way, with their reason.  Only a missing
    table counts as empty; one that cannot be read is an error."""
    spark = spark or new_rows.sparkSession
    good, bad = validate_news(new_rows.drop("id") if "id" in new_rows.columns else new_rows)
    known = stored_batches(spark, table_path)
    batch = max(known, default=-1) + 1 if batch is None else batch
    start = 0
    for b in sorted((b for b in known if b < batch), reverse=True):  # ids rise with the batch
        top = spark.read.schema(schemas.NEWS).parquet(f"{table_path}/batch={b}").agg(F.max("id")).first()[0]
        if top is not None:
            start = top + 1
            break
    with_ids = with_dense_id(good, ["link", "timestamp", "title", "source", "text"], "_n")
    stored = with_ids.withColumn("id", (F.col("_n") + F.lit(start)).cast("long"))
    stored = stored.select([f.name for f in schemas.NEWS.fields])
    stored.write.mode("overwrite").parquet(f"{table_path}/batch={batch}")
    bad.write.mode("overwrite").parquet(f"{table_path.rstrip('/')}_rejected/batch={batch}")
    return spark.read.schema(stored.schema).parquet(f"{table_path}/batch={batch}")


# SRC12 ----------------------------------------------------------------------
def get_news(df: DataFrame, news_id: int) -> DataFrame:
    return df.filter(F.col("id") == news_id).limit(1)


# SRC13 ----------------------------------------------------------------------
def merge_profiles(current: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Current profile per id from a change log.

    changes: (id, seq, state?, chat_id?, last_message_id?, add_okved?,
    reset_okveds?).  Latest non-NULL value by seq wins per field; a missing
    state is 'NEW' (get-or-create); okveds are the codes appended after the
    last reset, in seq order."""
    ch = changes
    for c, t in (("state", "string"), ("chat_id", "int"), ("last_message_id", "int"),
                 ("add_okved", "string"), ("reset_okveds", "boolean")):
        if c not in ch.columns:
            ch = ch.withColumn(c, F.lit(None).cast(t))
    if current is not None:
        base = current.select(
            "id", F.lit(LONG_MIN).cast("long").alias("seq"), "state", "chat_id", "last_message_id",
            F.lit(None).cast("string").alias("add_okved"), F.lit(None).cast("boolean").alias("reset_okveds"))
        # stored codes come before every change, in their stored order
        seeded = current.select("id", F.posexplode("okveds").alias("p", "add_okved")).select(
            "id", (F.lit(LONG_MIN + 1) + F.col("p")).alias("seq"), "add_okved")
        ch = ch.select(base.columns).unionByName(base).unionByName(
            seeded.select("id", "seq", F.lit(None).cast("string").alias("state"),
                          F.lit(None).cast("int").alias("chat_id"),
                          F.lit(None).cast("int").alias("last_message_id"), "add_okved",
                          F.lit(None).cast("boolean").alias("reset_okveds")))

    def latest(c):
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq")))

    agg = ch.groupBy("id").agg(
        latest("state").alias("state"), latest("chat_id").alias("chat_id"),
        latest("last_message_id").alias("last_message_id"),
        F.max(F.when(F.col("reset_okveds"), F.col("seq"))).alias("_reset"),
        F.collect_list(F.when(F.col("add_okved").isNotNull(), F.struct("seq", "add_okved"))).alias("_adds"),
        F.max("seq").alias("seq"))
    kept = F.filter("_adds", lambda x: F.coalesce(x["seq"] >= F.col("_reset"), F.col("_reset").isNull()))
    if current is not None:  # without a change, the stored number stays
        agg = agg.join(current.select("id", F.col("seq").alias("_stored")), "id", "left").withColumn(
            "seq", F.greatest("seq", "_stored"))
    return agg.select("id", "seq", "chat_id", F.coalesce("state", F.lit("NEW")).alias("state"),
                      "last_message_id",
                      F.transform(F.array_sort(kept), lambda x: x["add_okved"]).alias("okveds"))


# SRC14 ----------------------------------------------------------------------
def write_landing(df: DataFrame, path: str, ts_col: str = "timestamp", mode: str = "append") -> str:
    """Append-only landing zone partitioned by source and day."""
    (df.withColumn("date", F.to_date(F.col(ts_col))).hint("rebalance", "source", "date").write.mode(mode)
       .partitionBy("source", "date").json(path))
    return path
