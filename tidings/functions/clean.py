"""Cleaning and normalisation (CLN1-CLN13).

Everything is a native expression except Unicode normalisation (no built-in)
and the strict HTML mode, which run as Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import unicodedata
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import _c
from .wordlists import MAX_URL_LENGTH, RU_KEEP, RU_STOPWORDS

# Fixed value: whitespace class (ASCII controls, NEL and Unicode separators).
SPACE_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"

# The named character references of the HTML standard, from the standard
# library, by first letter: a lookup walks through the names of one letter only.
_NAMED = {a: "\x02".join(f"{k[:-1]}\x01{v}" for k, v in sorted(html5.items()) if k.endswith(";") and k[0] == a)
          for a in sorted({k[0] for k in html5})}
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# A tag ends at the first '>' outside quotes; a stray quote ends it at the next '>'.
TAG = r"<[A-Za-z/!?](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[A-Za-z/!?][^<>]*+>"
# What is not shown: script, style and template bodies and comments.  One that is
# never closed reaches to the end, so no part of a text is searched twice.
HIDDEN = r"(?is)<(script|style|template)\b[^<>]*+>.*?(?:</\1\s*+>|\z)|<!--.*?(?:-->|\z)"

# RFC 3986 appendix B: scheme, authority, path, query, fragment.
URI_PATTERN = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


# CLN1 -----------------------------------------------------------------------
def _entity_char(e: Column) -> Column:
    """The characters of one reference; unknown names stay as written."""
    body = F.substring(e, F.lit(2), F.length(e) - 2)
    code = (F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10))
            .when(body.startswith("#"), F.substring(body, F.lit(2), F.length(body))).cast("int"))
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    names = F.create_map(*[x for a, named in _NAMED.items() for x in (
        F.lit(a), F.str_to_map(F.lit(named), F.lit("\x02"), F.lit("\x01")))])
    name = F.element_at(F.element_at(names, F.substring(body, 1, 1)), body)
    return F.when(body.startswith("#"), char).otherwise(F.coalesce(name, e))


def decode_entities(c) -> Column:
    """Named and numeric character references, each decoded once."""
    x = _c(c)
    found = F.transform(F.regexp_extract_all(x, F.lit(ENTITY), F.lit(0)), _entity_char)
    pieces = F.split(x, ENTITY, -1)
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.concat(found, F.array(F.lit(""))),
                                               lambda a, b: F.array(a, b))), "")
    return F.when(x.rlike(ENTITY), joined).otherwise(x)


def html_to_text(c) -> Column:
    """Visible text of an HTML fragment: script/style/template bodies and
    comments dropped (to the end, if they are never closed), tags removed
    without separator, entities decoded.  Linear in the text's length."""
    return decode_entities(F.regexp_replace(F.regexp_replace(_c(c), HIDDEN, ""), TAG, ""))


class _TextCollector(HTMLParser):
    _SKIP = {"script", "style", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in self._SKIP:
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in self._SKIP and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def _strict_text(s: str | None) -> str | None:
    if s is None:
        return None
    p = _TextCollector()
    p.feed(s)
    p.close()
    return "".join(p.parts)


@F.pandas_udf(T.StringType())
def html_to_text_strict(s: pd.Series) -> pd.Series:
    """CLN1 strict mode: the standard-library HTML parser per value."""
    return s.map(_strict_text)


# CLN2 -----------------------------------------------------------------------
def norm_space(c) -> Column:
    return F.trim(F.regexp_replace(_c(c), SPACE_CLASS + "+", " "))


# CLN3 -----------------------------------------------------------------------
def _nfc(v):
    return None if v is None else unicodedata.normalize("NFC", v)


@F.pandas_udf(T.StringType())
def _nfc_udf(s: pd.Series) -> pd.Series:
    return s.map(_nfc)


def _make_norm_udf(form: str):
    @F.pandas_udf(T.StringType())
    def _udf(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize(form, v))
    return _udf


def norm_unicode(c, form: str = "NFC") -> Column:
    return _nfc_udf(_c(c)) if form == "NFC" else _make_norm_udf(form)(_c(c))


# CLN4 -----------------------------------------------------------------------
def _uri_part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, URI_PATTERN, group)


def remove_dot_segments(path) -> Column:
    """RFC 3986 section 5.2.4 on a path that begins with '/'."""
    p = _c(path)
    parts = F.split(p, "/", -1)
    ends = F.element_at(parts, -1).isin(".", "..")
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), lambda acc, x: F.when(
        x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
        F.concat(acc, F.array(x))))
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    return F.when(p.contains("/."), clean).otherwise(p)


def _clean_path(ref: Column) -> Column:
    """Dot segments of the path removed, query and fragment kept."""
    path = F.regexp_extract(ref, r"^[^?#]*", 0)
    return F.concat(remove_dot_segments(path), F.substring(ref, F.length(path) + 1, F.length(ref)))


def resolve_url(base, ref) -> Column:
    """Resolve one reference against a base URL (absolute, '//', '/', '?',
    '#', '' and relative forms), dot segments removed."""
    b, r = _c(base), _c(ref)
    scheme = _uri_part(b, 2)
    authority = _uri_part(b, 3)
    path = _uri_part(b, 5)
    query = _uri_part(b, 6)
    origin = F.concat(scheme, F.lit(":"), authority)
    base_no_frag = F.concat(origin, path, query)
    directory = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return (F.when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), r)
            .when(r.startswith("//"), F.concat(scheme, F.lit(":"), r))
            .when(r.startswith("/"), F.concat(origin, _clean_path(r)))
            .when(r.startswith("?"), F.concat(origin, path, r))
            .when(r.startswith("#"), F.concat(base_no_frag, r))
            .when(r == "", base_no_frag)
            .otherwise(F.concat(origin, _clean_path(F.concat(directory, r)))))


def resolve_urls(base, arr) -> Column:
    return F.transform(_c(arr), lambda x: resolve_url(_c(base), x))


# CLN5 / CLN6 / CLN8 -----------------------------------------------------------
def parse_iso(c) -> Column:
    """ISO-8601 string -> wall-clock TIMESTAMP_NTZ (NULL when unparsable).
    A stamp with an offset becomes Moscow wall time, like every other row of
    the corpus; one without is taken as it stands."""
    x = _c(c)
    wall = F.try_to_timestamp(x).cast("timestamp_ntz")
    moscow = F.convert_timezone(F.current_timezone(), F.lit("Europe/Moscow"), wall)
    return F.when(x.rlike(r"[T ][0-9:.]+ ?(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?)$"), moscow).otherwise(wall)


def clamp_epoch(c) -> Column:
    return F.greatest(_c(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def to_iso(c) -> Column:
    """Python ``isoformat``: seconds, plus microseconds only when non-zero."""
    ts = _c(c)
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))


# CLN7 -----------------------------------------------------------------------
def with_dense_id(df: DataFrame, order_by: list[str], id_col: str = "id") -> DataFrame:
    """Dense ids 0..N-1 in ``order_by`` order without a single-task window.

    Rows are range-partitioned and sorted, the result is checkpointed so that
    both passes see the same partitions, per-partition counts (one row per
    partition) give offsets, and each row adds its position in the partition.
    """
    from ..session import cut_lineage
    part = "_tid_part"
    pos = "_tid_pos"
    ordered = (df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
               .withColumn(part, F.spark_partition_id())
               .withColumn(pos, F.monotonically_increasing_id()))
    ordered = cut_lineage(ordered)
    # monotonically_increasing_id puts the partition id in the upper 31 bits
    local = F.col(pos) - F.shiftleft(F.col(part).cast("long"), 33)
    counts = ordered.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per partition: a proven size bound, so broadcasting is safe
    return (ordered.join(F.broadcast(offsets), part)
            .withColumn(id_col, (F.col("_off") + local).cast("long"))
            .drop(part, pos, "_off"))


# CLN9 -----------------------------------------------------------------------
URL_SYNTAX = r"^https?://([^\s/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^\s/?#:@\[\]]+)(:[0-9]+)?([/?#][^\s]*)?$"


def validation_reason(required: list[str], url_col: str = "link", urls_col: str | None = None) -> Column:
    """First failed check as a string, NULL when the record is valid; every
    element of ``urls_col`` is checked like ``url_col``."""
    expr = F.lit(None).cast("string")
    checks = [(F.col(c).isNull(), f"missing {c}") for c in required]
    checks.append((~F.col(url_col).rlike(URL_SYNTAX), f"bad url {url_col}"))
    checks.append((F.length(url_col) > MAX_URL_LENGTH, f"url too long {url_col}"))
    if urls_col:
        bad = lambda u: F.coalesce(~u.rlike(URL_SYNTAX) | (F.length(u) > MAX_URL_LENGTH), F.lit(True))
        checks.append((F.coalesce(F.exists(urls_col, bad), F.lit(False)), f"bad url in {urls_col}"))
    for cond, why in reversed(checks):
        expr = F.when(F.coalesce(cond, F.lit(True)), F.lit(why)).otherwise(expr)
    return expr


def validate_news(df: DataFrame, required=("link", "text", "title", "source", "timestamp", "refers_to"),
                  url_col: str = "link") -> tuple[DataFrame, DataFrame]:
    """Split into (good, bad-with-reason); both are lazy views of one scan."""
    urls_col = "refers_to" if "refers_to" in df.columns else None
    tagged = df.withColumn("_reason", validation_reason(list(required), url_col, urls_col))
    good = tagged.filter(F.col("_reason").isNull()).drop("_reason")
    bad = tagged.filter(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason")
    return good, bad


# CLN10 - CLN13 ----------------------------------------------------------------
def clean_text(cols: list, keep: str = RU_KEEP, stop: list[str] = RU_STOPWORDS) -> Column:
    """Lower-case, letters outside ``keep`` -> space, fields joined with a
    space, stop words dropped, hyphens split, spaces squeezed."""
    chars = keep.replace("\\", "\\\\").replace("]", "\\]").replace("-", "\\-").replace(" ", "")
    fields = [F.lower(_c(c)) for c in cols]
    words = F.split(F.concat_ws(" ", *fields), f"[^{chars}]+")
    drop = ["", *stop]
    joined = F.array_join(F.filter(words, lambda w: ~w.isin(drop)), " ")
    hyphens = F.trim(F.regexp_replace(F.replace(joined, F.lit("-"), F.lit(" ")), " +", " "))
    return F.when(F.contains(joined, F.lit("-")), hyphens).otherwise(joined)


def flatten_taxonomy(keep: str = RU_KEEP, stop: list[str] = RU_STOPWORDS) -> Column:
    """SectionName + Name + Notes (NULL Notes skipped by concat_ws)."""
    return clean_text(["SectionName", "Name", F.coalesce(F.col("Notes"), F.lit(""))], keep, stop)


def flatten_news(keep: str = RU_KEEP, stop: list[str] = RU_STOPWORDS) -> Column:
    return clean_text(["title", "text"], keep, stop)


def taxonomy_label() -> Column:
    return F.concat(F.lower(F.col("SectionName")), F.lit(" > "), F.lower(F.col("Name")))
