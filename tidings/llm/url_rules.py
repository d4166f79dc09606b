"""URL filter rules by a sort-merge range join with a sweep.

The canonical key of a host and a path is the host's labels in reverse order
and then the path, so a rule's key is the prefix of the keys that it fits on
its host, an interval in sorted order.  A url stands for one key per
host that it is a subdomain of (itself included, no more labels than the
longest rule has).  Keys and rules are range-partitioned at sampled keys - a
rule goes to every range that its interval meets, a key that is itself several
cuts is dealt to all ranges between them - and sorted together; one sweep
per range keeps the stack of active nested rules: what is no prefix of the
current key is popped, a rule is pushed, and a url's key takes the top, the
longest path.  Of the urls' keys the longest rule wins, host and path counted.

A sample of at most ``SAMPLE`` keys, each of at most ``CUT_CHARS``, decides
where ranges are cut and nothing else; results do not depend on it.

Defined cases: a null url, or one without ``://``, has an empty host and path
and no rule but one with an empty host and path; no rule gives ``default``; of
rules with one key, ``block`` wins over ``allow``; repeated rows and null ids
are returned as they come; an empty table gives no rows, no rules give every
url the default; other columns are passed over.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import stage
from tidings.session import read_table

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
DEFAULT = "allow"
SAMPLE = 20_000
CUT_CHARS = 256
_LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _host_keys(host: Column, most: int) -> Column:
    """The host's last 1 to ``most`` labels, in reverse order."""
    labels = F.reverse(F.split(host, r"\."))
    upto = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most)))
    return F.transform(upto, lambda n: F.array_join(F.slice(labels, 1, n), "."))


def _cuts(keys: DataFrame, parts: int) -> list[str]:
    """Up to ``parts - 1`` keys that part the sampled keys evenly."""
    if parts < 2:
        return []
    got = sorted(r[0] for r in keys.orderBy(F.xxhash64("tag", "key")).select(
        F.substring("key", 1, CUT_CHARS)).limit(min(SAMPLE, 64 * parts)).collect())
    return [got[len(got) * i // parts] for i in range(1, parts)] if got else []


def _sweep(batches):
    """Rows in order of (part, key, rules first): the innermost active rule."""
    stack: list[tuple[str, str, str]] = []
    part = None
    for b in batches:
        tags, rules, verdicts, sizes = [], [], [], []
        for p, key, tag, rule, verdict in zip(*(b.column(i).to_pylist() for i in range(5))):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if tag is None:
                stack.append((key, rule, verdict))
            elif stack:
                tags.append(tag)
                rules.append(stack[-1][1])
                verdicts.append(stack[-1][2])
                sizes.append(len(stack[-1][1]))
        yield pa.RecordBatch.from_arrays([pa.array(tags, pa.int64()), pa.array(sizes, pa.int32()),
                                          pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                                         names=["tag", "size", "rule", "verdict"])


def _part_of(cuts: list[str]):
    """First and last range that ``key`` (or every key it begins) may be in."""
    def run(batches):
        for b in batches:
            lo, hi = [], []
            for key, tag in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                head = key[:CUT_CHARS]
                lo.append(bisect.bisect_left(cuts, head))
                hi.append(bisect.bisect_right(cuts, head if tag is not None else head + _LAST))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                                             names=["key", "tag", "rule", "verdict", "lo", "hi"])
    return run


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id",
               url_col: str = "url", parts: int | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every page;
    ``rules`` has ``verdict``, ``host`` and ``path``."""
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(url_col).cast("string")
    rows = stage(pages.select(F.monotonically_increasing_id().alias("tag"), F.col(id_col).alias("page_id"),
                              host_of(url).alias("host"), path_of(url).alias("path")), "urls")
    written = rules.select(
        F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), "path").alias("key"),
        F.lit(None).cast("long").alias("tag"), F.concat("host", "path").alias("rule"), "verdict",
        F.size(F.split("host", r"\.")).alias("labels"))
    written = stage(written.where("key is not null").groupBy("key").agg(F.first("tag").alias("tag"), F.max("rule").alias("rule"),
                                               F.max("verdict").alias("verdict"), F.max("labels").alias("labels")),
                    "url-rules")
    most = written.agg(F.max("labels")).first()[0] or 1
    keys = rows.select(F.explode(_host_keys(F.col("host"), most)).alias("k"), "path", "tag").select(
        F.concat("k", "path").alias("key"), "tag", F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("verdict"))
    cuts = _cuts(keys, parts)
    placed = keys.unionByName(written.drop("labels")).mapInArrow(
        _part_of(cuts), "key string, tag long, rule string, verdict string, lo int, hi int")
    spread = F.when(F.col("tag").isNull(), F.sequence("lo", "hi")).otherwise(
        F.array(F.col("lo") + F.pmod(F.xxhash64("tag"), F.col("hi") - F.col("lo") + 1).cast("int")))
    events = placed.withColumn("part", F.explode(spread)).select("part", "key", "tag", "rule", "verdict")
    swept = (events.repartition(len(cuts) + 1, "part")
             .sortWithinPartitions("part", "key", F.col("tag").asc_nulls_first())
             .mapInArrow(_sweep, "tag long, size int, rule string, verdict string"))
    best = swept.groupBy("tag").agg(F.max(F.struct("size", "rule", "verdict")).alias("best"))
    return rows.join(best, "tag", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), rule_table(spark))


ORACLE = r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
best AS (
  SELECT u.page_id, arg_max(r.host || r.path, len(r.host || r.path)) AS rule,
         arg_max(r.verdict, len(r.host || r.path)) AS verdict
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM u LEFT JOIN best USING (page_id)
"""
