"""Page extraction as column expressions (EXT1-EXT17).

Per-site parsers become rules over regular expressions; paragraphs are split
on their opening tags so that unclosed ``<p>`` elements end where the next one
starts, as an HTML parser would close them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import decode_entities, html_to_text, norm_space, parse_iso, resolve_url
from .scalars import _c
from .wordlists import MAX_URL_LENGTH, RU_MONTHS_GENITIVE

# Fixed value: what counts as a URL in plain text.
URL_IN_TEXT_PATTERN = (r"https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b"
                       r"[-a-zA-Z0-9()@:%_\+.~#?&/=]*")


def inner(html, tag: str, attrs: str = r"[^<>]*+") -> Column:
    """Content of the first ``<tag attrs>...</tag>`` (non-nested); empty if it is
    never closed, which is found out once (the second alternative)."""
    return F.regexp_extract(_c(html), rf"(?is)<{tag}\b{attrs}>(?:(.*?)</{tag}>|.*+)", 1)


# EXT1 ------------------------------------------------------------------------
def extract_title(html, tag: str = "h1") -> Column:
    """Title: text of the first heading element, spaces normalised."""
    return norm_space(html_to_text(inner(html, tag)))


def extract_meta(html, prop: str) -> Column:
    """Title / date from a ``<meta property=... content=...>`` attribute."""
    return F.regexp_extract(_c(html), rf'(?is)<meta[^<>]*property="{prop}"[^<>]*content="([^"]*)"', 1)


# EXT2 ------------------------------------------------------------------------
def strip_blocks(c, tag: str = "div") -> Column:
    """Remove inner (non-nested) blocks such as info boxes or ads; what stands
    in one that is never closed stays."""
    return F.regexp_replace(_c(c), rf"(?is)<{tag}\b[^<>]*+>(?:.*?</{tag}>|(.*+))", "$1")


def paragraphs(container) -> Column:
    """Raw paragraph bodies: split on opening ``<p>`` tags, each piece cut at
    its ``</p>``; text before the first paragraph is dropped."""
    pieces = F.split(_c(container), r"(?i)<p\b[^<>]*+>")
    body = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(body, lambda p: F.regexp_extract(p, r"(?is)^(.*?)(?:</p\s*>|$)", 1))


def extract_body(html, container: str = "article", drop_blocks: str | None = "div",
                 sep: str = " ") -> Column:
    """Body: paragraphs of the container joined by ``sep``, inner blocks
    removed, tags stripped, spaces normalised."""
    cont = inner(html, container)
    if drop_blocks:
        cont = strip_blocks(cont, drop_blocks)
    ps = F.transform(paragraphs(cont), lambda p: norm_space(html_to_text(p)))
    return F.array_join(F.filter(ps, lambda p: p != ""), sep)


# rule table (EXT1 / EXT2) -------------------------------------------------------
_ATTRS = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""


def _attribute_of(tag: Column, name: Column) -> Column:
    """Value of the attribute named by a column; NULL without it."""
    value = F.call_function("regexp_extract", tag, F.concat(F.lit(r"(?is)[\s\"']"), name,
                                           F.lit(r"\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)")), F.lit(1))
    bare = F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return F.when(value != "", decode_entities(bare))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def element(html, tag: Column, attr: Column, value: Column, last: Column) -> Column:
    """(tag, content) of the first or last ``tag`` element whose ``attr`` has the
    word ``value`` (any, when ``attr`` is NULL); inner elements of the same
    name are counted, so the content ends at the element's own close."""
    x = _c(html)
    pattern = F.concat(F.lit("(?is)</?"), tag, F.lit(r"(?=[\s>/])" + _ATTRS))

    def fits(t):
        words = F.concat(F.lit(" "), F.coalesce(_attribute_of(t, F.coalesce(attr, F.lit("-"))), F.lit("")), F.lit(" "))
        return ~t.startswith("</") & (attr.isNull() | F.contains(words, F.concat(F.lit(" "), value, F.lit(" "))))

    def start(s):
        places = F.filter(F.transform(s["tags"], lambda t, i: F.when(fits(t), i)), lambda i: i.isNotNull())
        return F.when(last, F.try_element_at(places, F.lit(-1))).otherwise(F.get(places, F.lit(0)))

    def steps(s):  # depth change of every tag
        return F.transform(s["tags"], lambda t: F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1))

    def end(s):  # the tag that closes the element, else the number of tags
        after = F.slice(s["steps"], s["at"] + 2, F.size(s["steps"]))
        found = F.aggregate(after, F.struct(F.lit(1).alias("d"), s["at"].alias("i")), lambda acc, d: F.when(
            acc["d"] <= 0, acc).otherwise(F.struct((acc["d"] + d).alias("d"), (acc["i"] + 1).alias("i"))))
        return F.when(found["d"] <= 0, found["i"]).otherwise(F.size(s["steps"]))

    def content(s):
        n = s["end"] - s["at"]
        between = F.zip_with(F.slice(s["pieces"], s["at"] + 2, n), F.slice(s["tags"], s["at"] + 2, n - 1),
                             lambda p, t: F.concat(p, F.coalesce(t, F.lit(""))))
        return F.struct(F.get(s["tags"], s["at"]).alias("tag"), F.array_join(between, "").alias("content"))

    s0 = F.struct(F.call_function("regexp_extract_all", x, pattern, F.lit(0)).alias("tags"),
                  F.split(x, pattern, -1).alias("pieces"))
    with_start = let(s0, lambda s: F.struct(s["tags"].alias("tags"), s["pieces"].alias("pieces"), start(s).alias("at"),
                                            steps(s).alias("steps")))
    with_end = let(with_start, lambda s: F.when(s["at"].isNotNull(), F.struct(
        s["tags"].alias("tags"), s["pieces"].alias("pieces"), s["at"].alias("at"), end(s).alias("end"))))
    return let(with_end, lambda s: F.when(s.isNotNull(), content(s)))


def extract_by_rules(pages: DataFrame, rules: DataFrame, site_col: str, html_col: str = "html") -> DataFrame:
    """``pages`` with ``fields``, a map of field name to value.

    ``rules`` has a row per site (NULL: every site) and field: ``mode`` 'text'
    (the element's visible text), 'attr' (its attribute ``arg``), 'json' (the
    path ``arg`` of a JSON page); ``tag``, ``attr`` and ``value`` name the
    element, ``last`` takes the last such one.  A site's rules travel as one
    array, so a page is read once and nothing is grouped."""
    cols = ("field", "mode", "tag", "attr", "value", "arg", "last")
    per_site = rules.groupBy(F.col("site").alias("_site")).agg(F.collect_list(F.struct(*cols)).alias("_own"))
    everywhere = per_site.where("_site is null").select("_own")  # one row
    joined = (pages.join(per_site.where("_site is not null"), F.col(site_col) == F.col("_site"), "left")
              .withColumn("_all", everywhere.scalar()))
    none = F.array().cast(per_site.schema["_own"].dataType)

    def apply(r):
        found = element(html_col, F.coalesce(r["tag"], F.lit("html")), r["attr"], r["value"], F.coalesce(r["last"], F.lit(False)))
        of_element = let(found, lambda e: F.when(r["mode"] == "attr", _attribute_of(e["tag"], F.coalesce(r["arg"], F.lit("-"))))
                         .otherwise(norm_space(html_to_text(e["content"]))))
        value = F.when(r["mode"] == "json", F.call_function("get_json_object", F.col(html_col), r["arg"])).otherwise(of_element)
        return F.struct(r["field"].alias("key"), value.alias("value"))
    used = F.concat(F.coalesce("_all", none), F.coalesce("_own", none))
    return joined.withColumn("fields", F.map_from_entries(F.transform(used, apply))).drop("_site", "_own", "_all")


# EXT3 ------------------------------------------------------------------------
def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in double, single or no quotes; NULL without it."""
    value = F.regexp_extract(tag, rf"(?is)(?:^|[\s\"']){name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    bare = F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return F.when(value != "", decode_entities(bare))


def anchors(c) -> Column:
    """Every ``<a>`` with an ``href``: array of (href, text)."""
    pieces = F.split(_c(c), r"(?i)<a(?=[\s/>])")
    after = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    tag = lambda p: F.regexp_extract(p, r"(?s)^(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+", 0)
    found = F.transform(after, lambda p: F.struct(
        _attribute(tag(p), "href").alias("href"),
        norm_space(html_to_text(F.regexp_extract(F.substring(p, F.length(tag(p)) + 2, F.length(p)),
                                                 r"(?is)^(.*?)(?:</a\b|$)", 1))).alias("text")))
    return F.filter(found, lambda a: a["href"].isNotNull())


def extract_links(c, drop_texts: list[str] | None = None) -> Column:
    """Every ``href`` value in the given markup, but for links whose text is
    one of ``drop_texts``."""
    found = anchors(c)
    if drop_texts:
        found = F.filter(found, lambda a: ~a["text"].isin(list(drop_texts)))
    return F.transform(found, lambda a: a["href"])


# EXT4 ------------------------------------------------------------------------
def filter_links(arr, base=None, deny: list[str] | None = None, need_dot: bool = True) -> Column:
    """Links resolved against ``base`` and then kept when they contain '.',
    are no mailto: / file:// links, have at most 2083 characters, are not
    letters and digits only and are not in ``deny``; a link that begins with
    '/' is kept as its host's."""
    deny = list(deny or [])

    def keep(x):
        raw, full = x["raw"], x["full"]
        ok = ~raw.contains("file://") & (F.length(full) <= MAX_URL_LENGTH) & ~raw.rlike(r"^[\p{L}\p{N}]+$")
        if deny:
            ok = ok & ~raw.isin(deny) & ~full.isin(deny)
        if need_dot:
            ok = ok & full.contains(".")
        return ~raw.contains("mailto:") & (raw != "") & (raw.startswith("/") | ok)

    pairs = F.transform(_c(arr), lambda x: F.struct(
        x.alias("raw"), (x if base is None else resolve_url(_c(base), x)).alias("full")))
    return F.transform(F.filter(pairs, keep), lambda x: x["full"])


# EXT5 ------------------------------------------------------------------------
def prepare_url(url, host) -> Column:
    """Host prefix for relative links; http(s), mailto and tel kept."""
    u = _c(url)
    keep = u.startswith("http") | u.startswith("mailto:") | u.startswith("tel:")
    joined = F.when(u.startswith("/"), F.concat(_c(host), u)).otherwise(F.concat(_c(host), F.lit("/"), u))
    return F.when(keep, u).otherwise(joined)


def host_of(url) -> Column:
    """scheme://authority of a URL."""
    return F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


# EXT6 ------------------------------------------------------------------------
def first_link_per_p(container) -> Column:
    """First link of every paragraph that has one, joined by newlines."""
    firsts = F.transform(paragraphs(container), lambda p: F.get(anchors(p), F.lit(0))["href"])
    return F.array_join(F.filter(firsts, lambda x: x.isNotNull() & (x != "")), "\n")


# EXT7 ------------------------------------------------------------------------
def text_urls(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(URL_IN_TEXT_PATTERN), 0)


# EXT8 / EXT9 -------------------------------------------------------------------
def id_from_url(url, pattern: str = r"/([0-9]+)([?#/]|$)") -> Column:
    return F.regexp_extract(_c(url), pattern, 1)


def ids_from_links(df: DataFrame, links_col: str, key_cols: list[str], pattern: str = r"/([0-9]+)([?#/]|$)") -> DataFrame:
    """Distinct ids found in links, per key (e.g. per day)."""
    ex = df.select(*key_cols, F.explode(links_col).alias("_l"))
    return (ex.select(*key_cols, id_from_url("_l", pattern).alias("id"))
            .filter(F.col("id") != "").distinct())


def id_in_url(url) -> Column:
    """Last path segment (a trailing '/' ignored)."""
    return F.regexp_extract(_c(url), r"([^/]*)/?$", 1)


# EXT10 -----------------------------------------------------------------------
# Site timestamp formats (Python strptime form -> Spark pattern).
SITE_FORMATS = {
    "%d.%m.%Y %H:%M": "dd.MM.yyyy HH:mm",
    "%Y-%m-%d %H:%M:%S": "yyyy-MM-dd HH:mm:ss",
}


def parse_site_ts(c, fmt: str) -> Column:
    """Site date strings -> TIMESTAMP_NTZ.  fmt: a key of SITE_FORMATS,
    'epoch' (UTC wall time), 'epoch_msk' (Moscow wall time) or 'iso'
    (fraction cut; with an offset, Moscow wall time)."""
    x = _c(c)
    if fmt in SITE_FORMATS:
        return F.try_to_timestamp(x, F.lit(SITE_FORMATS[fmt])).cast("timestamp_ntz")
    if fmt == "epoch":
        return F.timestamp_seconds(x.cast("long")).cast("timestamp_ntz")
    if fmt == "epoch_msk":
        return F.convert_timezone(F.lit("UTC"), F.lit("Europe/Moscow"),
                                  F.timestamp_seconds(x.cast("long")).cast("timestamp_ntz"))
    if fmt == "iso":
        cut = F.regexp_replace(x, r"\.[0-9]+", "")
        return parse_iso(cut)
    raise ValueError(f"unknown format {fmt}")


# EXT11 -----------------------------------------------------------------------
def parse_ru_date(c) -> Column:
    """'4 января 2022[, 10:15]' -> TIMESTAMP_NTZ (absolute dates only)."""
    x = F.lower(F.trim(_c(c)))
    for i, m in enumerate(RU_MONTHS_GENITIVE, start=1):
        x = F.regexp_replace(x, rf"\s{m}\s", f".{i:02d}.")
    x = F.regexp_replace(x, r"^([0-9])\.", "0$1.")
    x = F.regexp_replace(x, r",?\s+", " ")
    return F.coalesce(F.try_to_timestamp(x, F.lit("dd.MM.yyyy HH:mm")),
                      F.try_to_timestamp(x, F.lit("dd.MM.yyyy"))).cast("timestamp_ntz")


# EXT12 -----------------------------------------------------------------------
def route_posts(posts: DataFrame, type_col: str = "type") -> DataFrame:
    """simple -> title '' and links from the text; news / review kept as
    special posts; any other type dropped.  One pass, no branches."""
    t = F.col(type_col)
    return (posts.filter(t.isin("simple", "news", "review"))
            .withColumn("title", F.when(t == "simple", F.lit("")).otherwise(F.col("title")))
            .withColumn("refers_to", F.when(t == "simple", text_urls("text"))
                        .otherwise(F.coalesce(F.col("refers_to"), F.array().cast("array<string>")))))


# EXT13 -----------------------------------------------------------------------
def messages_to_news(msgs: DataFrame, base: str = "https://t.me/") -> DataFrame:
    """Message text (else caption) becomes the title, TEXT_LINK urls of the
    text's entities (for a caption, of ``caption_entities`` if there are any)
    the references, the link is built from channel and id; text is ''.
    Messages with neither text nor caption are dropped."""
    title = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.nullif(F.col("caption"), F.lit("")))
    own = F.col("entities")
    if "caption_entities" in msgs.columns:
        from_text = F.coalesce(F.col("text") != "", F.lit(False))
        own = F.when(from_text, own).otherwise(F.coalesce("caption_entities", "entities"))
    links = F.transform(F.filter(F.coalesce(own, F.array()), lambda e: e["type"] == "TEXT_LINK"),
                        lambda e: e["url"])
    return (msgs.withColumn("_title", title).filter(F.col("_title").isNotNull())
            .select(F.concat(F.lit(base), F.col("channel"), F.lit("/"), F.col("id").cast("string")).alias("link"),
                    F.lit("").alias("text"), F.col("_title").alias("title"),
                    F.col("channel").alias("source"), F.col("date").alias("timestamp"),
                    links.alias("refers_to")))


# EXT14 -----------------------------------------------------------------------
def standardise(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename / project to the record schema: {target: source column}."""
    return df.select(*[F.col(src).alias(dst) for dst, src in mapping.items()])


# EXT15 -----------------------------------------------------------------------
def join_preview(previews: DataFrame, articles: DataFrame, key: str = "url") -> DataFrame:
    """Listing attributes (id / url / date) joined to the parsed article."""
    return previews.join(articles, key, "inner")


# EXT16 / EXT17 ------------------------------------------------------------------
def date_spine(start, end, descending: bool = False) -> Column:
    """Days from start to end (inclusive) as an array column to explode."""
    s, e = _c(start).cast("date"), _c(end).cast("date")
    seq = F.sequence(s, e, F.expr("INTERVAL 1 DAY"))
    return F.reverse(seq) if descending else seq


def crawl_plan(params: DataFrame, base_col: str = "base", day_col: str = "day",
               optional: list[str] = ("type", "bloc"), fixed: list[str] = ("size", "sort"),
               cursor_col: str | None = "cursor") -> DataFrame:
    """Request URLs for every (parameter row, day): zero-valued optional
    segments are omitted and a cursor is appended when present.  Each
    parameter row carries its own date range; days come from ``explode``,
    so no join is needed."""
    with_days = params.withColumn(day_col, F.explode(date_spine("start", "end")))
    segs = [F.concat(F.lit(f"{c}="), F.col(c)) for c in fixed]
    segs += [F.when(F.col(c).isNotNull() & (F.col(c) != "0"), F.concat(F.lit(f"{c}="), F.col(c))) for c in optional]
    segs += [F.concat(F.lit("d="), F.dayofmonth(day_col).cast("string")),
             F.concat(F.lit("m="), F.month(day_col).cast("string")),
             F.concat(F.lit("y="), F.year(day_col).cast("string"))]
    if cursor_col:
        segs.append(F.when(F.col(cursor_col).isNotNull(), F.concat(F.lit("cursor="), F.col(cursor_col))))
    return with_days.withColumn("url", F.concat(F.col(base_col), F.lit("?"), F.concat_ws("&", *segs)))


def day_url(day, base: str, path: str = "business/", filter_type: str = "all") -> Column:
    """Listing URL of one day: base + path + ?filterType=..&d=..&m=..&y=.."""
    d = _c(day)
    return F.concat(F.lit(f"{base}{path}?filterType={filter_type}&d="), F.dayofmonth(d).cast("string"),
                    F.lit("&m="), F.month(d).cast("string"), F.lit("&y="), F.year(d).cast("string"))
