import zlib

import numpy as np

from tidings.llm import language_id as L
from tidings.llm.common import documents
from tidings.session import read_table

SF = "/root/testdata/sf0.01"


def test_held_out_documents_and_pages(spark):
    docs, pages = documents(spark, SF), read_table(spark, SF, "pages")
    rows = L.identify(docs, pages).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(got) == len(lang) and len(rows) == docs.count() + pages.count()
    held = [d for d in got if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([got[d].lang == lang[d] for d in held]) >= 0.97
    of_page = {r.page_id: r for r in rows if r.page_id is not None}
    assert np.mean([r.lang == r.declared for r in of_page.values()]) >= 0.95
    assert all(0.2 < r.score <= 1 for r in rows)


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)],
                                 "page_id long, url string, html string, lang string")


def test_other_evidence_decides_without_text(spark):
    docs = documents(spark, SF)
    de, en = (docs.where(f"lang = '{x}' and n_chars > 800").limit(30).collect() for x in ("de", "en"))
    page = lambda lang, text: f"<html lang='{lang}'><script>the and of</script><p>{text}</p></html>"
    rows = [(f"http://a.haus.de/{i}", page("de", r.text)) for i, r in enumerate(de)]
    rows += [(f"http://b.house.uk/{i}", page("en", r.text)) for i, r in enumerate(en)]
    n = len(rows)
    rows += [("http://a.haus.de/x", ""), ("http://b.house.uk/x", "<p></p>"), ("http://new.haus.de", None),
             ("http://other.org/", "<html lang=de></html>"), (None, "<html lang=en>"), (None, page("xx", de[0].text))]
    got = {r.page_id: r for r in L.identify(docs, _pages(spark, rows)).collect() if r.page_id is not None}
    assert [got[n + i].lang for i in range(6)] == ["de", "en", "de", "de", "en", "de"]
    assert got[0].score > got[n].score > 0.5


def test_host_prior_by_hand(spark):
    """Sums of the other records, smoothed level by level."""
    ll = [[0.0, -2.0], [0.0, -4.0], [-1.0, 0.0], [0.0, 0.0]]
    hosts = ["a.x.com", "a.x.com", "b.x.com", "c.y.com"]
    rows = spark.createDataFrame([(None, i, f"http://{h}/", h, None, v) for i, (h, v) in enumerate(zip(hosts, ll))],
                                 "doc_id long, page_id long, url string, host string, declared string, ll array<double>")
    got = {r.page_id: r for r in L.fuse(rows, ["p", "q"]).collect()}
    post = np.exp(ll) / np.exp(ll).sum(axis=1, keepdims=True)
    m, prior = L.SMOOTHING, post.sum(axis=0) / 4
    for i in range(4):
        d = [j for j in range(4) if hosts[j][2:] == hosts[i][2:] and j != i]
        h = [j for j in d if hosts[j] == hosts[i]]
        p = (post[d].sum(axis=0) + m * prior) / (len(d) + m)
        p = (post[h].sum(axis=0) + m * p) / (len(h) + m)
        suffix = (post.sum(axis=0) + m) / (post.sum(axis=0) + m)
        s = np.exp(ll[i]) * p * suffix
        assert abs(got[i].score - (s / s.sum()).max()) < 1e-5


def test_visible_text():
    page = "<p>one<!-- no --> two<SCRIPT>no</SCRIPT> three &amp; é<style>no</style></p><script>never closed"
    assert L.visible(page).split() == ["one", "two", "three", "&", "é"]
    L.visible("<script>" * 100_000)
    assert L.declared_language("<!DOCTYPE html><HTML class=a lang = 'DE-at'>") == "de"
    assert L.declared_language("<p lang=de>") is None


def test_awkward_rows(spark, docs):
    pages = _pages(spark, [(None, None), ("", ""), ("x", "<"), ("http://é.ü/", "<html lang=>")] * 2)
    got = L.identify(docs, pages).collect()
    assert len(got) == docs.count() + 8 and all(r.lang in ("en", "de", "fr", "es") for r in got)


def test_empty(spark, docs, no_docs):
    pages = _pages(spark, [("http://a.b/", "text")])
    got = L.identify(no_docs, pages).collect()
    assert [(r.lang, r.score) for r in got] == [(None, None)]
    assert L.identify(no_docs, pages.limit(0)).collect() == []
    assert len(L.identify(docs, pages.limit(0)).collect()) == docs.count()


def test_declared_language_behind_a_long_comment():
    page = f"<!-- {'x' * 30_000} -->{' ' * 30_000}<html class='{'c' * 3_000}' lang=\"de-AT\"><body>"
    assert L.declared_language(page) == "de"
    assert L.declared_language("<html><p lang='fr'>") is None
    assert L.declared_language("<html " * 50_000) is None
