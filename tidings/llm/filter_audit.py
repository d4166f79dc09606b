"""Filter interaction audit over relations of failing ids.

One pass over the texts gives every document's facts; every filter writes the
ids of the documents that fail it as a table of its own.  All prefixes of all
orders are then worked out on ids alone, by joins with these tables:

* a left-anti join of (document, set of filters) with the failing ids of the
  set's filters leaves each prefix's survivors;
* a left-semi join of (survivor, next filter) with that filter's failing ids
  gives what the filter removes there, and the labels lost with it;
* what fails a filter without being removed by it is redundant there; what a
  filter removes after all others only it removes.

What a prefix leaves does not depend on its order, so n filters have 2^n
prefixes, and the n! orders only look them up.  Documents that fail no
filter survive every prefix and are counted once.  Ids are shuffled once by
document and once per join's other side; documents' keys are unique, so no
key is hot, and the side that a hash join keeps in memory has at most one
row per document and filter.  Rows equal in id and text are counted before.

Defined cases: a null text is empty, a null ``lang`` the part ``''``; a null id
is a document of its own text that copies nothing and has no labels; repeated
rows count each; rows of ``labels`` with the same id count as one, with each
label that any of them has; an empty table gives no rows; other columns are
passed over, whatever their names; a long text is read whole in one task.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import LONG_MIN, documents, stage, text_of
from tidings.llm.words import texts_of, words_of
from tidings.session import read_table, scratch_path

_SYMBOLS = re.compile(rb"[#$%&*|]")
_NOT_UPPER = bytes(set(range(256)) - set(range(ord("A"), ord("Z") + 1)))
_CONTINUED = bytes(range(0x80, 0xC0))
_FACTS = "id long, part string, words long, distinct long, upper long, points long, symbols boolean, digest binary"


def text_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per document ``id``, ``part``, numbers of ``words``, ``distinct`` words,
    capitals (``upper``) and code ``points``, whether it holds ``symbols``, and
    the text's SHA-256 ``digest``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            facts = []
            for text in texts_of(b.column(2)):
                words = words_of(text)
                facts.append((len(words), len(set(words)), len(text.translate(None, _NOT_UPPER)),
                              len(text.translate(None, _CONTINUED)), _SYMBOLS.search(text) is not None,
                              hashlib.sha256(text).digest()))
            types = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
            columns = list(zip(*facts)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=["id", "part", "words", "distinct", "upper", "points", "symbols", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, _FACTS)


def later_copies(facts: DataFrame) -> DataFrame:
    """Rows whose text some smaller id has too: all that are not the first of
    their text.  The join is on text and id, so copies spread."""
    known = facts.where("id is not null")
    firsts = known.groupBy("digest").agg(F.min("id").alias("id"))
    return known.join(firsts, ["digest", "id"], "left_anti")


#: Failure conditions of the registered query, on the facts of ``text_facts``.
FILTERS: dict[str, str | None] = {
    "A": "words < 200",
    "B": "100 * distinct < 50 * words",
    "C": "100 * upper > 3 * points",
    "D": "symbols",
    "E": None,  # a copy of a document with a smaller id
}


def failing_ids(facts: DataFrame, filters: dict[str, str | None] = FILTERS) -> dict[str, DataFrame]:
    """One written table of (``id``, ``key``) per filter; ``key`` tells apart
    the texts of one id.  A filter without condition fails later copies."""
    spark = facts.sparkSession
    base = scratch_path(spark, "failing")
    tables = {}
    for name, condition in filters.items():
        rows = later_copies(facts) if condition is None else facts.where(condition)
        rows.select(*_document()).distinct().write.parquet(f"{base}/{name}")
        tables[name] = spark.read.schema("id long, key long").parquet(f"{base}/{name}")
    return tables


def _document() -> list[Column]:
    key = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    return [F.coalesce("id", F.lit(LONG_MIN)).alias("id"), key.alias("key")]


def labelled(facts: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(``id``, ``key``, ``part``, ``good``, ``toxic``) with the number ``n`` of such rows."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = facts.select("id", "part", *[c.alias(f"_{i}") for i, c in enumerate(_document())])
    joined = rows.where("id is not null").join(known, "id", "left").select("_0", "_1", "part", "good", "toxic")
    none = F.lit(None).cast("int")
    nulls = rows.where("id is null").select("_0", "_1", "part", none.alias("good"), none.alias("toxic"))
    flag = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    return (joined.unionByName(nulls).select(F.col("_0").alias("id"), F.col("_1").alias("key"), "part", *flag)
            .groupBy("id", "key", "part", "good", "toxic").agg(F.count(F.lit(1)).alias("n")))


def audit(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """The audit of every order of the filters: per ``part``, ``filter_order``
    and ``step`` what is kept, removed, redundant, failed by that filter only,
    the labels lost and the filter's removals over all orders."""
    spark, names = rows.sparkSession, list(failing)
    bits = {name: 1 << i for i, name in enumerate(names)}
    every = (1 << len(names)) - 1
    fails = None
    for name, table in failing.items():
        one = table.select("id", "key", F.lit(bits[name]).alias("bit"))
        fails = one if fails is None else fails.unionByName(one)
    # the hash join keeps at most one row per document and filter of its
    # partition; the other side, 2^n rows a document, is neither sorted nor kept
    fails = fails.repartition("id", "key")
    rows = rows.repartition("id", "key")
    on = ["id", "key"]
    clean = rows.join(fails.hint("shuffle_hash"), on, "left_anti")
    touched = rows.join(fails.hint("shuffle_hash"), on, "left_semi")

    f = fails.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "bit").hint("shuffle_hash")
    same = (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key"))
    tried = touched.withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit(every))))
    survivors = tried.join(f, same & (F.col("prefix").bitwiseAND(F.col("bit")) != 0), "left_anti")
    coming = survivors.withColumn("next", F.explode(F.array(*[F.lit(b) for b in bits.values()]))).where(
        F.col("prefix").bitwiseAND(F.col("next")) == 0)
    removed = coming.join(f, same & (F.col("next") == F.col("bit")), "left_semi")

    left = survivors.groupBy("part", "prefix").agg(F.sum("n").alias("left"))
    always = clean.groupBy("part").agg(F.sum("n").alias("always"))
    gone = removed.groupBy("part", "prefix", F.col("next").alias("bit")).agg(
        F.sum("n").alias("removed"), F.sum(F.col("n") * F.col("good")).alias("good_lost"),
        F.sum(F.col("n") * F.col("toxic")).alias("toxic_lost"))
    gone = stage(gone, "removed")  # one row per part, prefix and filter
    # orders in which the prefix stands before the filter
    times = {p: math.factorial(k) * math.factorial(max(len(names) - 1 - k, 0)) for p in range(every + 1) for k in [p.bit_count()]}
    weight = F.element_at(F.array(*[F.lit(times[p]) for p in range(every + 1)]), F.col("prefix") + 1)
    per_filter = gone.groupBy("part", "bit").agg(
        F.sum(F.when(F.col("prefix") == 0, F.col("removed"))).alias("failing"),
        F.sum(F.when(F.col("prefix") == F.lit(every) - F.col("bit"), F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * weight).alias("shapley"))

    steps = []
    for order in itertools.permutations(names):
        prefix = 0
        for step, name in enumerate(order, 1):
            steps.append((len(steps), "".join(order), step, prefix, bits[name], prefix | bits[name]))
            prefix |= bits[name]
    plan = F.broadcast(spark.createDataFrame(  # n! n rows, whatever the input
        steps, "row int, filter_order string, step int, prefix int, bit int, after int"))
    parts = rows.groupBy("part").agg(F.sum("n").alias("n")).drop("n")
    out = parts.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).join(plan, "row")
    out = out.join(gone, ["part", "prefix", "bit"], "left").join(per_filter, ["part", "bit"], "left")
    out = out.join(left.withColumnRenamed("prefix", "after"), ["part", "after"], "left").join(always, "part", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("part", "filter_order", "step", (zero("left") + zero("always")).alias("kept"),
                      zero("removed").alias("removed"), (zero("failing") - zero("removed")).alias("redundant"),
                      *[zero(c).alias(c) for c in ("unique_fails", "good_lost", "toxic_lost", "shapley")])


def audit_documents(docs: DataFrame, labels: DataFrame, filters: dict[str, str | None] = FILTERS,
                    id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Facts, failing ids and audit of a table of documents."""
    facts = stage(text_facts(docs, id_col, text_col, part_col), "facts")
    return audit(labelled(facts, labels, id_col), failing_ids(facts, filters))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
fails AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed FROM texts),
lab AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
grouped AS (
  SELECT part, failed, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM fails LEFT JOIN lab USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN translate(failed, before || f, '') = failed THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN translate(failed, before, '') = failed AND contains(failed, f) THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN translate(failed, before, '') <> failed AND contains(failed, f) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN translate(failed, before, '') = failed AND contains(failed, f) THEN n * good ELSE 0 END) AS good_lost,
         sum(CASE WHEN translate(failed, before, '') = failed AND contains(failed, f) THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM grouped, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
