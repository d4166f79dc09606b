"""Hand-made markup with answers written by hand."""

import time

import pytest
from pyspark.sql import functions as F

from tidings.functions import clean as C
from tidings.functions import extract as E


def values(spark, rows, *cols):
    df = spark.createDataFrame([(r,) if isinstance(r, str) or r is None else r for r in rows], "x string, y string"
                               if isinstance(rows[0], tuple) else "x string")
    out = [tuple(r) for r in df.select(*cols).collect()]
    return [r[0] for r in out] if len(cols) == 1 else out


def test_html_to_text(spark):
    got = values(spark, ["a &#8212; b &#x27;c&#X27; &eacute;&nbsp;&amp;lt; &unknown; & x; &#0; &#1114112;",
                         "<p title='a>b' class=\"x<y\">text</p>", "1 < 2 and 3 > 2", "<a href=\"x>no end",
                         "<SCRIPT>if (a<b) {}</SCRIPT>z<!-- <p> -->", "<br/>x<br >y</p\n>", None],
                 C.html_to_text("x"))
    assert got == ["a — b 'c' é &lt; &unknown; & x; � �", "text", "1 < 2 and 3 > 2",
                   "no end", "z", "xy", None]


def test_long_markup_is_linear(spark):
    big = "<a " + "x='1' " * 20_000 + ">" + "<" * 50_000 + "&" * 50_000 + "text"
    assert values(spark, [big], F.length(C.html_to_text("x")))[0] == 100_004


@pytest.mark.parametrize("unit", ["<script>", "<style>x", "<template ", "<!--", "<script", "<!-- <script>", "</script", "<p>",
                                  "<article>", "<div>", "<h1 ", "<a href='x", "&CounterClockwiseContourIntegral;", "<p <p"])
def test_a_megabyte_of_anything_unclosed_is_quick(spark, unit):
    text = "seen " + unit * (1_000_000 // len(unit))
    for fn in (C.html_to_text, E.extract_title, E.extract_body, lambda c: E.inner(c, "article")):
        df = spark.createDataFrame([(text,)], "x string").select(F.length(fn("x")).alias("n"))
        df.collect()  # compiled before it is timed
        began = time.perf_counter()
        df.collect()
        assert time.perf_counter() - began < 2


def test_what_is_never_closed_reaches_to_the_end(spark):
    pages = ["a<script>b<b>c", "a<!-- b --", "a<!-- <script> -->b</script>c", "<STYLE>x</style>y<template>z"]
    assert values(spark, pages, C.html_to_text("x")) == ["a", "a", "abc", "y"]
    assert values(spark, ["<h1>t", "<h1>t</h1>u", "<h1>t<h1>v</h1>"], E.extract_title("x")) == ["", "t", "tv"]
    assert values(spark, ["a<div>b</div>c", "a<div>b<div>c", "a<div>b</div>c<div>d"], E.strip_blocks("x")) == [
        "ac", "ab<div>c", "acd"]


def test_links(spark):
    page = ("<A HREF='one.html'>1</A><a class=x href=two>2 <b>b</b></a><a name=z>no</a><abbr href=q>no</abbr>"
            "<a title='a>b' href=\"/three?a=1&amp;b=2\">full text</a><a\nhref = '#four'>4</a>")
    assert values(spark, [page], E.extract_links("x")) == [["one.html", "two", "/three?a=1&b=2", "#four"]]
    assert values(spark, [page], E.extract_links("x", ["full text", "2 b"])) == [["one.html", "#four"]]


def test_links_are_resolved_then_tested(spark):
    refs = ["story", "/story", "a.html", "mailto:x@y.org", "file://c.txt", "abc123", "слово", "../up/x.html",
            "https://other.org/a/../b", "#top", "", "https://denied.org/", "x" * 3000 + ".html"]
    df = spark.createDataFrame([("https://a.org/dir/page?q", refs)], "base string, refs array<string>")
    got = df.select(E.filter_links("refs", "base", ["https://denied.org/"])).first()[0]
    assert got == ["https://a.org/story", "https://a.org/dir/a.html", "https://a.org/up/x.html",
                   "https://other.org/a/../b", "https://a.org/dir/page?q#top"]


@pytest.mark.parametrize("ref,want", [
    ("../q", "http://h.org/x/q"), ("./q", "http://h.org/x/y/q"), ("../../../q", "http://h.org/q"), ("..", "http://h.org/x/"),
    (".", "http://h.org/x/y/"), ("/a/./b/../c?d=/../e", "http://h.org/a/c?d=/../e"), ("g;x=1/../y", "http://h.org/x/y/y"),
    ("q.html", "http://h.org/x/y/q.html"), ("..g", "http://h.org/x/y/..g"), ("//n.org/../a", "http://n.org/../a")])
def test_dot_segments(spark, ref, want):
    assert values(spark, [("http://h.org/x/y/z?k=1", ref)], C.resolve_url("x", "y")) == [want]


def test_urls_in_text(spark):
    text = ("see https://a.org/x, or (http://www.b.ru/y?z=1#t); «https://c.com/д» http://localhost/ "
            "https://d.io. next ftp://e.org")
    assert values(spark, [text], E.text_urls("x")) == [
        ["https://a.org/x", "http://www.b.ru/y?z=1#t)", "https://c.com/", "https://d.io."]]


def test_paragraphs(spark):
    page = "<article><P>one <a href='a.html'>x</a></P>tail<p>two</p ><p>three<a href=b>1</a><a href=c>2</a></article>"
    assert values(spark, [page], E.extract_body("x", "article")) == ["one x two three12"]
    assert values(spark, [page], E.first_link_per_p(E.inner("x", "article"))) == ["a.html\nb"]


def test_stamps_are_moscow_wall_time(spark):
    rows = ["2024-01-02T10:00:00+03:00", "2024-01-02T10:00:00Z", "2024-01-02T10:00:00", "2024-01-02 10:00:00.5+01:00",
            "2012-07-01T00:00:00+00:00", "2024-01-02", "nonsense", None]
    got = values(spark, rows, C.parse_iso("x").cast("string"))
    assert got == ["2024-01-02 10:00:00", "2024-01-02 13:00:00", "2024-01-02 10:00:00", "2024-01-02 12:00:00.5",
                   "2012-07-01 04:00:00", "2024-01-02 00:00:00", None, None]
    assert values(spark, rows[:2], E.parse_site_ts("x", "iso").cast("string")) == got[:2]


def test_records_with_bad_references_are_rejected(spark):
    rows = [("http://u:p@[::1]:80/x", ["http://ok.org/"]), ("http://a.org", ["nonsense"]), ("http://a.org", []),
            ("ftp://a.org", []), ("http://a.org", ["http://a.org/" + "x" * 3000]), ("http://a.org", [None])]
    df = spark.createDataFrame([(link, "t", "t", "s", "d", refs) for link, refs in rows],
                               "link string, text string, title string, source string, timestamp string, "
                               "refers_to array<string>")
    good, bad = C.validate_news(df)
    assert [r.link for r in good.collect()] == ["http://u:p@[::1]:80/x", "http://a.org"]
    assert [r.reason for r in bad.collect()] == ["bad url in refers_to", "bad url link", "bad url in refers_to",
                                                 "bad url in refers_to"]


def test_caption_entities(spark):
    ent = "array<struct<type:string,url:string>>"
    rows = [("c", 1, "text", "cap", [("TEXT_LINK", "u1")], [("TEXT_LINK", "u2")]),
            ("c", 2, "", "cap", [], [("TEXT_LINK", "u2"), ("BOLD", "u3")]), ("c", 3, None, None, [], [])]
    df = spark.createDataFrame(rows, f"channel string, id long, text string, caption string, entities {ent}, "
                                     f"caption_entities {ent}").withColumn("date", F.lit("2024-01-01").cast("timestamp"))
    got = [(r.title, r.refers_to) for r in E.messages_to_news(df).orderBy("link").collect()]
    assert got == [("text", ["u1"]), ("cap", ["u2"])]


def test_clean_tokens_of_underscores(spark):
    from tidings.functions.scalars import clean_tokens
    got = values(spark, ["Foo_bar _baz 1abc x ёж a1 é2_", "Foo 1abc x ёж a1, it's", None], clean_tokens("x"))
    assert got == [["foo bar", "baz", "eж", "a1", "é2"], ["foo", "eж", "a1", "it"], []]


def test_rules_by_site(spark):
    page = ("<html><h1 class='big content-title'>T &amp; U</h1><div class=content--full>a<div class='x'>b</div>c</div>"
            "<div class='news-content'>first</div><div class='news-content'>l<div>a</div>st</div>tail"
            "<meta itemprop=dateModified content='2024-01-02'/></html>")
    pages = spark.createDataFrame([(1, "v", page), (2, "j", '{"data": {"title": "J"}}'), (3, "none", page), (4, "v", None)],
                                  "id long, site string, html string")
    rules = spark.createDataFrame(
        [("v", "title", "text", "h1", "class", "content-title", None, False),
         ("v", "body", "text", "div", "class", "content--full", None, False),
         ("v", "last", "text", "div", "class", "news-content", None, True),
         ("v", "date", "attr", "meta", "itemprop", "dateModified", "content", False),
         ("v", "gone", "text", "h2", None, None, None, False),
         ("j", "title", "json", None, None, None, "$.data.title", False)],
        "site string, field string, mode string, tag string, attr string, value string, arg string, last boolean")
    got = {r.id: r.fields for r in E.extract_by_rules(pages, rules, "site").collect()}
    assert got[1] == {"title": "T & U", "body": "abc", "last": "last", "date": "2024-01-02", "gone": None}
    assert got[2] == {"title": "J"} and got[3] == {}
    assert set(got[4].values()) == {None}
