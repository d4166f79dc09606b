"""Mixing sources to target weights with a low-discrepancy schedule.

Sources get target shares by weight; no source is taken more than
``MAX_EPOCHS`` times over, and what a capped source cannot give is shared
again among the others by weight until none is above its cap.

A source's documents, in an order given by a hash, form one stream of words
that is cut into blocks of ``BLOCK_WORDS``.  Slot i of the mix has the van der
Corput point of i (its bits reversed); the interval of the cumulative slot
demand that holds the point names the slot's source.  The slots of a source
are ranked, and slot k takes block k of the source's stream, which begins
anew after its last block; the last slot ends at the target.  Points fall into
the intervals evenly up to a few slots; the ranks a source then lacks are
appended at even distances, so its words come out at the target.

Everything is DataFrame operations.  Prefix sums and ranks over a source are
taken in two levels, within bounded groups (hash ranges of ``GROUP_ROWS``
documents, runs of ``RUN_SLOTS`` slots) and over the groups' totals, so a
source that holds a third of all rows is no single task.  Order and points
depend on the data alone: reruns agree.

Defined cases: a null text has no words; a document without words has no slice
and is not in the mix; a null source is a source of its own, ordered last; a source
without words has target 0; a null id is hashed as empty; rows equal in id, text
and source each count and stand one behind the other (ties); an empty table gives
no rows; other columns are passed over by ``mix`` and ``mixed_texts`` and kept
by ``mixed_documents``, whatever their names; a long text is one row, met by as
many blocks as it spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.llm.common import documents, fresh_names, stage, text_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 2048
GROUP_ROWS = 2_000
RUN_SLOTS = 65_536
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words between ASCII white space: each word and the white space after
    it become one character, counted after the leading white space."""
    marks = F.regexp_replace(text, _WORD + r"[\x20\x09-\x0D]*", "x")
    return F.length(F.regexp_replace(marks, r"^[\x20\x09-\x0D]+", "")).cast("long")


def order_hash(id_col: str, text_col: str, source_col: str) -> Column:
    """The same for rows equal in id, text and source alone."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"),
                          F.md5(text_of(text_col).cast("binary")), F.lit("|"),
                          F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))).cast("binary"))


def words_between(text: Column, first: Column, n: Column) -> Column:
    """``n`` words of the text from number ``first`` on, with the white space
    between them as it stands (and that before the text's first word)."""
    pieces = F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*" + _WORD + ")")), first.cast("int") + 1, n.cast("int"))
    whole = F.array_join(pieces, "")
    return F.when(first > 0, F.regexp_replace(whole, r"^[\x20\x09-\x0D]+", "")).otherwise(whole)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``size`` and ``h`` (order within the source)."""
    return stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                             n_words(text_of(text_col)).alias("size"),
                             order_hash(id_col, text_col, source_col).alias("h")), "mix-sizes")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: ``sid``, ``source``, ``rows``, ``source_size``,
    ``target``.

    A round gives every uncapped source its weight's part of what the capped
    ones leave and caps those above; caps only grow, and rounds end when none
    is added.  The driver sees two sums a round.
    """
    per = stage(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"),
                                            F.sum("size").alias("source_size")), "mix-sources")
    rank = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    per = stage(per.withColumn("sid", F.row_number().over(rank).cast("long") - 1)
                .withColumn("weight", w).withColumn("most", F.col("source_size") * max_epochs), "mix-weights")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, n_capped = 0.0, -1
    while True:
        capped = F.col("most") < F.col("weight") * F.lit(level) if n_capped >= 0 else F.lit(False)
        s = per.agg(F.sum(F.when(capped, F.col("most")).otherwise(0)).alias("given"),
                    F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("weight"),
                    F.sum(capped.cast("long")).alias("n")).first()
        if (s["n"] or 0) == n_capped or not s["weight"]:
            break
        level, n_capped = (total - s["given"]) / s["weight"], s["n"]
    share = F.col("weight") * F.lit(level)
    target = F.when(F.col("most") < share, F.col("most").cast("double")).otherwise(share)
    return per.select("sid", "source", "rows", "source_size", target.alias("target"))


def _with_stream_offsets(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``offset``: the words before the document in its source's stream."""
    groups = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("rows") / GROUP_ROWS).cast("long"))
    bits = F.conv(F.substring("h", 1, 7), 16, 10).cast("long")  # 28 leading bits
    keyed = (sizes.join(sources.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src")))
             .withColumn("g", F.floor(bits * groups / F.lit(1 << 28)).cast("long")))
    totals = keyed.groupBy("sid", "g").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sid").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("sid", "g", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "g").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return (keyed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(bases, ["sid", "g"])
            .select("doc_id", "sid", "size", "source_size", "target", "h",
                    (F.col("base") + F.col("within")).alias("offset")))


def _reverse_bits(i: Column) -> Column:
    """The 64 bits in reverse order, by swapping ever larger halves."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F),
                        (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        m = F.lit(mask).cast("long")
        i = F.shiftleft(i.bitwiseAND(m), shift).bitwiseOR(F.shiftrightunsigned(i, shift).bitwiseAND(m))
    return F.shiftleft(i, 32).bitwiseOR(F.shiftrightunsigned(i, 32))


def van_der_corput(i: Column) -> Column:
    """Point i of the base-2 sequence in [0, 1), exact to 53 bits."""
    return F.shiftrightunsigned(_reverse_bits(i), 11).cast("double") / F.lit(float(1 << 53))


def _demand(sources: DataFrame, block: int) -> DataFrame:
    """Adds ``words`` (the target, rounded), ``blocks`` of the source, ``slots``
    that it needs and ``lo``, ``hi``: its interval of the cumulative demand."""
    z, t = F.col("source_size"), F.col("words")
    d = (sources.where("source_size > 0").withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
         .withColumn("blocks", F.ceil(z / block).cast("long"))
         .withColumn("slots", F.floor(t / z).cast("long") * F.col("blocks")
                     + F.ceil(F.pmod(t, z) / F.lit(block)).cast("long")))
    upto = Window.orderBy("sid")  # one row per source
    return (d.withColumn("end", F.sum("slots").over(upto))
            .withColumn("all", F.sum("slots").over(Window.partitionBy()))
            .withColumn("lo", (F.col("end") - F.col("slots")) / F.col("all"))
            .withColumn("hi", F.col("end") / F.col("all")).drop("end"))


def schedule(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix as slots: ``position`` (their order), ``sid``, ``epoch``,
    ``block`` and ``words`` (the block's first words that the slot takes)."""
    spark = sources.sparkSession
    demand = stage(_demand(sources, block), "mix-demand")
    s = demand.agg(F.max("all").alias("n"), F.count(F.lit(1)).alias("k")).first()
    n, cells = s["n"] or 0, 4 * max(1, s["k"])
    points = spark.range(n).select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * cells).cast("long"))
    # an interval stands in every cell that it meets: cells + sources rows
    held = demand.select("sid", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") * cells).cast("long"), F.floor(F.col("hi") * cells).cast("long"))).alias("cell"))
    drawn = (points.join(held, "cell").where("point >= lo and point < hi")
             .select("slot", "sid", F.floor(F.col("slot") / RUN_SLOTS).cast("long").alias("run")))
    counts = drawn.groupBy("sid", "run").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("sid", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    in_run = Window.partitionBy("sid", "run").orderBy("slot")
    ranked = (drawn.withColumn("k", F.row_number().over(in_run).cast("long") - 1).join(bases, ["sid", "run"])
              .select("sid", F.col("slot").cast("double").alias("position"), (F.col("k") + F.col("base")).alias("k")))
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    lacking = (demand.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long")))
               .where("got < slots")
               .select("sid", F.explode(F.sequence("got", F.col("slots") - 1)).alias("k"), "slots", "all")
               .select("sid", ((F.col("k") + 0.5) * F.col("all") / F.col("slots")).alias("position"), "k"))
    slots = ranked.unionByName(lacking).join(demand, "sid").where("k < slots")
    at = F.floor(F.col("k") / F.col("blocks")).cast("long")
    b = F.pmod("k", "blocks")
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - b * block)
    left = F.col("words") - at * F.col("source_size") - b * block
    return slots.select("position", "sid", at.alias("epoch"), b.alias("block"), F.least(length, left).alias("words"))


def block_slices(streams: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Each document's part of each block that it meets: ``in_block`` and
    ``in_doc`` are where it begins, ``length`` its words."""
    first, last = (F.floor(x / block).cast("long") for x in (F.col("offset"), F.col("offset") + F.col("size") - 1))
    cut = streams.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest("offset", F.col("block") * block)
    end = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block)
    return cut.select("h", "doc_id", "sid", "block", (begin - F.col("block") * block).alias("in_block"),
                      (begin - F.col("offset")).alias("in_doc"), (end - begin).alias("length"))


def mixed_slices(slots: DataFrame, slices: DataFrame) -> DataFrame:
    """The mix itself: for every slot the slices of its block, trimmed."""
    taken = F.least("length", F.col("words") - F.col("in_block"))
    return (slots.join(slices, ["sid", "block"]).where("in_block < words")
            .select("position", "sid", "epoch", "block", "in_block", "h", "doc_id", "in_doc",
                    taken.alias("taken")))


def _prepared(docs: DataFrame, weights: tuple, max_epochs: int, id_col: str, text_col: str,
              source_col: str) -> tuple[DataFrame, DataFrame]:
    """Sources with their targets, and documents with their places in the streams."""
    sizes = sized(docs, id_col, text_col, source_col)
    sources = stage(targets(sizes, weights, max_epochs), "mix-targets")
    return sources, stage(_with_stream_offsets(sizes, sources), "mix-streams")


def mixed_texts(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK_WORDS,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix to be read in order: ``position`` (of the slot; slots of equal
    position by ``sid``, ``epoch``, ``block``) and ``in_block`` give the order,
    ``doc_id``, ``in_doc`` and ``text`` the words that stand there."""
    sources, streams = _prepared(docs, weights, max_epochs, id_col, text_col, source_col)
    parts = mixed_slices(schedule(sources, block), block_slices(streams, block))
    texts = docs.select(order_hash(id_col, text_col, source_col).alias("h"), text_of(text_col).alias("text")).dropDuplicates(["h"])
    return parts.join(texts, "h").select("position", "sid", "epoch", "block", "in_block", "doc_id", "in_doc", "taken",
                                         words_between(F.col("text"), F.col("in_doc"), F.col("taken")).alias("text"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK_WORDS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``
    (its source's), ``taken`` (words of it in the mix, repeats counted) and
    ``h``, the hash that orders it."""
    sources, streams = _prepared(docs, weights, max_epochs, id_col, text_col, source_col)
    parts = mixed_slices(schedule(sources, block), block_slices(streams, block))
    # the slice's place in the stream tells equal rows apart
    begin = F.col("block") * block + F.col("in_block") - F.col("in_doc")
    sums = parts.groupBy("sid", begin.alias("offset")).agg(F.sum("taken").alias("taken"))
    sums = sums.withColumn("size", F.lit(1))
    words = streams.where("size > 0").join(sums.drop("size"), ["sid", "offset"], "left")
    none = streams.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return words.unionByName(none).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "h")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **options) -> DataFrame:
    """``docs`` as the mix takes them: a document's row once for every time it
    is taken whole, and once with its first words for a part of it."""
    cols = docs.columns
    h, taken, part, size, same = fresh_names(docs, "_h", "_taken", "_part", "_size", "_same")
    decided = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    # equal rows have equal hashes: what they give together is taken from one
    takes = stage(decided.where("taken > 0").groupBy(F.col("h").alias(h)).agg(
        F.sum("taken").alias(taken), F.max("size").alias(size), F.count(F.lit(1)).alias(same)), "mix-takes")
    rows = docs.withColumn(h, order_hash(id_col, text_col, source_col))
    # both joins read one shuffle of the texts
    single = rows.join(takes.where(F.col(same) == 1), h)
    several = rows.join(takes.where(F.col(same) > 1), h).dropDuplicates([h])
    found = single.unionByName(several).withColumn(
        part, F.explode(F.sequence(F.lit(0).cast("long"), F.col(taken) - 1, F.col(size))))
    left = F.col(taken) - F.col(part)
    out = found.withColumn(text_col, F.when(left >= F.col(size), F.col(text_col)).otherwise(
        words_between(F.col(text_col), F.lit(0), left)))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*cols)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("h")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) || '|' || coalesce('s' || source, 'n')) AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid
  FROM d GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * z AS most FROM per),
rounds(k, level, n) AS (
  SELECT 0, (SELECT sum(z) FROM w)::DOUBLE / (SELECT sum(weight) FROM w), 0::BIGINT
  UNION ALL
  SELECT k + 1, l, m FROM (
    SELECT r.k, r.n, (SELECT count(*) FROM w WHERE most < weight * r.level) AS m,
           ((SELECT sum(z) FROM w) - coalesce((SELECT sum(most) FROM w WHERE most < weight * r.level), 0))::DOUBLE
             / (SELECT sum(weight) FROM w WHERE NOT most < weight * r.level) AS l
    FROM rounds r) WHERE m > n),
t AS (
  SELECT source, sid, z, CASE WHEN most < weight * level THEN most::DOUBLE ELSE weight * level END AS target
  FROM w, (SELECT level FROM rounds ORDER BY k DESC LIMIT 1)),
s AS (
  SELECT d.*, t.z, t.target, floor(t.target + 0.5)::BIGINT AS words,
         coalesce(sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, z AS source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE words // z * size
             + least(greatest(words % z - off, 0), size) END)::BIGINT AS taken
FROM s
"""
