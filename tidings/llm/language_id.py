"""Language identification by Bayesian fusion of evidence.

The log posterior of a language is the sum of
 * the text's likelihood: letter trigrams of the visible text, hashed to
   ``BUCKETS``, under each language's counts; damped to ``TRIGRAMS`` independent
   trigrams, as neighbours overlap;
 * the likelihood of the declared markup language (the page's ``lang``) and of
   the address suffix, both learnt on the corpus by grouped sums of the
   texts' posteriors, so a site builder's default ``lang`` weighs little;
 * the host's prior, smoothed by its domain's, that by the corpus's: a
   group of n records adds its sums to ``SMOOTHING`` records of the level above.
   A record's own text is taken out of its host's and domain's sums first.

Trigram counts are fitted on labelled documents outside the held-out fold
(crc32 of the id mod 5 = 0), ``TRAIN_ROWS`` at most in expectation, chosen by
a hash of the id; every other statistic covers all records.  Texts are read once
more and never shuffled; per record only a few numbers are.  Hosts and
domains with many records are joined without shuffling those.

Defined cases: a null or empty text has no likelihood, other evidence
decides; a missing ``lang``, suffix or host is no evidence; without labelled
documents ``lang`` and ``score`` are null; ties go to the language first in order;
repeated rows and null ids are returned as they come; an empty table gives no
rows; other columns are passed over.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import documents, join_per_key, stage, text_of
from tidings.session import read_table

BUCKETS = 1 << 15
TRAIN_ROWS = 40_000
TRIGRAMS = 60
SMOOTHING = 5.0
ALPHA = 0.1
#: A-Z to a-z, other ASCII but letters to blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_HIDDEN = re.compile(r"<(script|style|!--)", re.I)
_CLOSE = {"!--": re.compile("-->"), "script": re.compile("</script[^<>]*>?", re.I),
          "style": re.compile("</style[^<>]*>?", re.I)}
_TAG = re.compile(r"<[^<>]*>")
_HTML = re.compile(r"<html\b[^<>]*+", re.I)
_LANG = re.compile(r"\slang\s{0,9}=\s{0,9}[\"']?([A-Za-z]{2,3})\b", re.I)


def trigrams(text: str) -> np.ndarray:
    """Hashed letter trigrams of the text, runs of other characters as one blank."""
    data = b" ".join(text.encode("utf-8", "surrogatepass").translate(_FOLD).split())
    if not data:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(17)).astype(np.int64) % BUCKETS


def visible(page: str) -> str:
    """The text between tags, without scripts, styles and comments; linear."""
    out, at = [], 0
    while m := _HIDDEN.search(page, at):
        out.append(page[at:m.start()])
        close = _CLOSE[m[1].lower()].search(page, m.end())
        at = close.end() if close else len(page)
    out.append(page[at:])
    return html.unescape(_TAG.sub(" ", "".join(out)))


def declared_language(page: str) -> str | None:
    """By the first ``<html>`` tag that names one, wherever it stands; linear."""
    for tag in _HTML.finditer(page):
        if m := _LANG.search(page, tag.start(), tag.end()):
            return m[1].lower()
    return None


def train(docs: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each trigram bucket in them."""
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))
    usable = docs.where(F.col(lang_col).isNotNull() & (fold != 0))
    n = usable.count()
    step = 1_000_000
    chosen = usable.where(F.pmod(F.xxhash64(id_col), F.lit(step)) < int(step * min(1.0, rows / max(n, 1))) + 1)

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                by.setdefault(lang, []).append(trigrams(text.as_py()))
            for lang, parts in by.items():
                c = np.bincount(np.concatenate(parts), minlength=BUCKETS)
                counts[lang] = counts[lang] + c if lang in counts else c
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(c[at], pa.int64())], names=["lang", "bucket", "n"])
    cells = (chosen.select(F.col(lang_col).alias("lang"), text_of(text_col).alias("text"))
             .mapInArrow(run, "lang string, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    got = cells.collect()  # at most BUCKETS rows per language
    langs = sorted({r.lang for r in got})
    table = np.full((len(langs), BUCKETS), ALPHA)
    for r in got:
        table[langs.index(r.lang), r.bucket] += r.n
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def likelihoods(records: DataFrame, model: np.ndarray) -> DataFrame:
    """``records`` (``doc_id``, ``page_id``, ``url``, ``host``, ``text``, ``page``)
    reduced to ids, address and the text's damped log likelihoods."""
    def run(batches):
        for b in batches:
            ll, said = [], []
            for text, page in zip(b.column(4), b.column(5)):
                raw = text.as_py()
                if page.as_py():
                    said.append(declared_language(raw))
                    raw = visible(raw)
                else:
                    said.append(None)
                t = trigrams(raw)
                s = model[:, t].sum(axis=1) if len(t) else np.zeros(len(model))
                s = s * min(1.0, TRIGRAMS / max(1, len(t)))
                ll.append(s - s.max(initial=-np.inf) if len(s) else s)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), b.column(3), pa.array(said, pa.string()),
                 pa.array(ll, pa.list_(pa.float64()))],
                names=["doc_id", "page_id", "url", "host", "declared", "ll"])
    return records.mapInArrow(run, "doc_id long, page_id long, url string, host string, declared string, "
                                   "ll array<double>")


def _softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, key: str, k: int) -> DataFrame:
    """Per ``key`` the number of records and the sum of ``post``."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array(
        *[F.sum(F.col("post")[i]) for i in range(k)]).alias("s"))


def _likelihood_of(sums: DataFrame, key: str, total: np.ndarray, out: str) -> DataFrame:
    """log P(key | language), smoothed by the key's share of all records."""
    per_lang = F.array(*[F.lit(float(x)) for x in total])
    share = F.col("n") / F.lit(float(total.sum()))
    ll = F.zip_with("s", per_lang, lambda a, t: F.log((a + F.lit(SMOOTHING) * share) / (t + F.lit(SMOOTHING))))
    return sums.where(F.col(key).isNotNull()).select(key, ll.alias(out))


def fuse(records: DataFrame, langs: list[str]) -> DataFrame:
    """``records`` from ``likelihoods``, staged, with their language."""
    k = len(langs)
    ids = ["doc_id", "page_id", "declared"]
    if not k:
        return records.select(*ids, F.lit(None).cast("string").alias("text_lang"),
                              F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("score"))
    names = F.array(*[F.lit(x) for x in langs])
    host = F.when(F.col("host") != "", F.col("host"))
    labels, is_page = F.split("host", r"\."), F.col("url").isNotNull()
    top = labels[F.size(labels) - 1]
    domain = F.when(is_page, F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), "."))
    suffix = F.when(is_page & top.rlike("^[a-z][a-z0-9-]{1,62}$"), top)
    # a document's source and a page's host are different things
    key = lambda c: F.unhex(F.md5(F.concat(
        is_page.cast("string"), F.lit("|"), F.coalesce(c, F.lit(""))).cast("binary")))
    keyed = stage(records.select(*ids, "ll", _softmax(F.col("ll")).alias("post"), suffix.alias("suffix"),
                                 key(host).alias("h"), key(domain).alias("d")), "language-records")
    sums = keyed.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("post")[i]).alias(f"s{i}") for i in range(k)]).first()
    n, total = sums["n"], np.array([sums[f"s{i}"] or 1.0 for i in range(k)])
    prior = F.array(*[F.lit(float(x)) for x in total / total.sum()])
    hosts = (keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("d").alias("d"), F.array(
        *[F.sum(F.col("post")[i]) for i in range(k)]).alias("s")))
    hosts = stage(hosts, "language-hosts")
    domains = _sums(keyed, "d", k).withColumnsRenamed({"n": "dn", "s": "ds"})
    per_domain = stage(domains.join(hosts.groupBy("d").agg(F.count(F.lit(1)).alias("hosts")), "d"), "language-domains")
    hosts = stage(join_per_key(hosts, per_domain, "d", "hosts", hosts.count()).drop("d", "hosts"), "language-priors")
    joined = join_per_key(keyed, hosts, "h", "n", n)
    # at most 26^2 + 26^3 declared codes
    joined = joined.join(F.broadcast(_likelihood_of(_sums(keyed, "declared", k), "declared", total, "of_declared")),
                         "declared", "left")
    suffixes = stage(_sums(keyed, "suffix", k), "language-suffixes")
    of_suffix = _likelihood_of(suffixes, "suffix", total, "of_suffix").join(
        suffixes.select("suffix", F.col("n").alias("sn")), "suffix")
    with_suffix = join_per_key(joined.where("suffix is not null"), of_suffix, "suffix", "sn", n).drop("sn")
    joined = with_suffix.unionByName(joined.where("suffix is null"), allowMissingColumns=True)
    m = F.lit(SMOOTHING)
    others = lambda s, p: F.greatest(s - p, F.lit(0.0))  # noqa: E731  without the record itself
    of_domain = F.zip_with(F.zip_with("ds", "post", others), prior, lambda a, p: (a + m * p) / (F.col("dn") - 1 + m))
    of_host = F.zip_with(F.zip_with("s", "post", others), of_domain, lambda a, p: (a + m * p) / (F.col("n") - 1 + m))
    none = F.array_repeat(F.lit(0.0), k)
    score = F.zip_with("ll", of_host, lambda a, p: a + F.log(F.greatest(p, F.lit(1e-12))))
    for extra in ("of_declared", "of_suffix"):
        score = F.zip_with(score, F.coalesce(extra, none), lambda a, b: a + b)
    best = lambda v: F.element_at(names, F.array_position(v, F.array_max(v)).cast("int"))
    out = joined.select(*ids, best(F.col("post")).alias("text_lang"), _softmax(score).alias("p"))
    return out.select(*ids, "text_lang", best(F.col("p")).alias("lang"), F.round(F.array_max("p"), 6).alias("score"))


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per document and per page: ``doc_id`` or ``page_id``, the
    ``declared`` language, ``text_lang`` by the text alone, ``lang`` and its
    posterior ``score``.  A document's ``source`` stands for its host."""
    langs, model = train(docs)
    of_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"),
                          F.lit(None).cast("string").alias("url"), F.col("source").cast("string").alias("host"),
                          text_of().alias("text"), F.lit(False).alias("page"))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    address = F.lower(F.regexp_extract(url, r"(?s)^.*?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    of_pages = pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"),
                            url.alias("url"), address.alias("host"), text_of("html").alias("text"),
                            F.lit(True).alias("page"))
    records = likelihoods(of_docs, model).unionByName(likelihoods(of_pages, model))
    return fuse(stage(records, "language-likelihoods"), langs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir), read_table(spark, sf_dir, "pages"))
