"""Invariant and brute-force checks for operators without an SQL oracle."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from table_paths import SF_MID, SF_SMALL


# ---- helpers -------------------------------------------------------------------
def planted(n_clusters=4, per=6, dims=8, noise=0.05, seed=3, singles=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n_clusters, dims))
    rows = []
    i = 0
    for c in centers:
        for _ in range(per):
            v = c + rng.normal(scale=noise, size=dims)
            rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist()))
            i += 1
    for _ in range(singles):
        v = rng.normal(size=dims)
        rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist()))
        i += 1
    return rows


def cos_dist(rows):
    m = np.array([r[1] for r in rows], dtype=np.float64)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return 1 - m @ m.T


def sequential_complete(rows, t):
    """Textbook complete linkage, merging the closest pair while < t."""
    d = cos_dist(rows)
    clusters = {r[0]: [k] for k, r in enumerate(rows)}
    while True:
        best = None
        keys = sorted(clusters)
        for a, b in itertools.combinations(keys, 2):
            dd = max(d[i, j] for i in clusters[a] for j in clusters[b])
            if dd < t and (best is None or (dd, a, b) < best):
                best = (dd, a, b)
        if best is None:
            break
        _, a, b = best
        clusters[a] += clusters.pop(b)
    return {frozenset(rows[i][0] for i in v) for v in clusters.values()}


def partition(df, id_col="id", label="label"):
    groups = {}
    for r in df.collect():
        groups.setdefault(r[label], set()).add(r[id_col])
    return {frozenset(v) for v in groups.values()}


# ---- clustering ------------------------------------------------------------------
@pytest.mark.parametrize("seed,t", [(3, 0.2), (5, 0.35), (11, 0.6)])
def test_complete_linkage_equals_sequential(spark, seed, t):
    from tidings.operators.cluster import cluster_complete
    rows = planted(seed=seed, noise=0.15)
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    got = partition(cluster_complete(df, t))
    assert got == sequential_complete(rows, t)


def test_complete_linkage_diameter_and_duplicates(spark):
    from tidings.operators.cluster import cluster_complete
    rows = planted(seed=7, noise=0.1)
    rows += [(100 + i, rows[i][1]) for i in range(6)]  # exact duplicates
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    labels = {r["id"]: r["label"] for r in cluster_complete(df, 0.3).collect()}
    d = cos_dist(rows)
    idx = {r[0]: k for k, r in enumerate(rows)}
    for a, b in itertools.combinations(labels, 2):
        if labels[a] == labels[b]:
            assert d[idx[a], idx[b]] < 0.3 + 1e-9
    for i in range(6):
        assert labels[100 + i] == labels[i]
    assert all(lab == min(k for k in labels if labels[k] == lab) for lab in labels.values())


def test_dbscan_equals_brute_force(spark):
    from tidings.operators.cluster import cluster_dbscan
    rows = planted(seed=9, noise=0.2)
    eps, m = 0.3, 3
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    got = {r["id"]: r["label"] for r in cluster_dbscan(df, eps, m).collect()}
    d = cos_dist(rows)
    n = len(rows)
    nb = [[j for j in range(n) if j != i and d[i, j] <= eps] for i in range(n)]
    core = [len(nb[i]) + 1 >= m for i in range(n)]
    lab = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            if core[i]:
                for j in nb[i]:
                    if core[j] and lab[j] < lab[i]:
                        lab[i] = lab[j]
                        changed = True
    want = {}
    for i in range(n):
        if core[i]:
            want[rows[i][0]] = rows[lab[i]][0]
        else:
            cl = [rows[lab[j]][0] for j in nb[i] if core[j]]
            want[rows[i][0]] = min(cl) if cl else -1
    assert got == want


def test_micro_clusters_radius_bound(spark):
    from tidings.operators.cluster import cluster_micro
    from tidings.plans import fixtures as X
    assign, summ = cluster_micro(X.vectors(spark, SF_SMALL), 0.5)
    assert summ.filter(F.col("radius") > 0.5 + 1e-9).count() == 0
    assert assign.count() == X.vectors(spark, SF_SMALL).count()
    assert summ.agg(F.sum("n")).first()[0] == assign.count()


# ---- vectors ---------------------------------------------------------------------
def test_ivf_full_probe_is_exact_and_recall(spark):
    from tidings.operators import knn as K
    from tidings.plans import fixtures as X
    v = X.vectors(spark, SF_MID).select("id", "vec")
    cells, centers, nlist, nprobe = K.build_index(v)
    exact = {(r["id"], r["nid"]) for r in K.knn_exact(v, v, 10).collect()}
    full = {(r["id"], r["nid"]) for r in K.knn_ivf(v, cells, centers, 10, nlist).collect()}
    assert full == exact
    part = {(r["id"], r["nid"]) for r in K.knn_ivf(v, cells, centers, 10, K.search_probes(nlist)).collect()}
    recall = len(part & exact) / len(exact)
    assert recall >= 0.9, recall


def test_knn_exact_blocked_equals_single_block(spark):
    from tidings.operators import knn as K
    from tidings.plans import fixtures as X
    v = X.vectors(spark, SF_SMALL).select("id", "vec")
    one = {(r["id"], r["nid"], r["rank"]) for r in K.knn_exact(v, v, 7).collect()}
    many = {(r["id"], r["nid"], r["rank"]) for r in K.knn_exact(v, v, 7, block_rows=37).collect()}
    assert one == many


def test_similar_pairs_blocked(spark):
    from tidings.operators import knn as K
    from tidings.plans import fixtures as X
    v = X.vectors(spark, SF_SMALL).select("id", "vec")
    a = {(r["a"], r["b"]) for r in K.similar_pairs(v, 0.7).collect()}
    b = {(r["a"], r["b"]) for r in K.similar_pairs(v, 0.7, block_rows=41).collect()}
    assert a == b and all(x < y for x, y in a)


# ---- text ---------------------------------------------------------------------------
def greedy_phrases(tokens, phrases):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in phrases:
            out.append(tokens[i] + "_" + tokens[i + 1])
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def test_apply_phrases_equals_greedy(spark):
    from tidings.operators.text import apply_phrases
    docs = [(1, ["a", "b", "c", "a", "b"]), (2, ["a", "b", "b", "c", "d"]), (3, ["b", "c", "c", "d"]),
            (4, []), (5, ["x"]), (6, ["a", "b", "b", "c", "c", "d", "d", "e"])]
    phr = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]
    td = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    ph = spark.createDataFrame(phr, "a string, b string")
    got = {r["doc_id"]: list(r["tokens"]) for r in apply_phrases(td, ph).collect()}
    assert got == {d: greedy_phrases(t, set(phr)) for d, t in docs}
    app = {r["doc_id"]: list(r["tokens"]) for r in apply_phrases(td, ph, "append").collect()}
    assert app[1] == ["a", "b", "c", "a", "b", "a_b", "a_b"]


def test_lda_mixtures_sum_to_one(spark):
    import __spark_entry__ as E
    rows = E.queries()["txt6_fit_lda"](spark, SF_SMALL).collect()
    # documents without any dictionary term get an all-zero mixture
    sums = [r["mix_sum"] for r in rows]
    assert rows and all(abs(x - 1.0) < 1e-6 or x == 0.0 for x in sums)
    assert sum(abs(x - 1.0) < 1e-6 for x in sums) >= 0.8 * len(sums)  # keyword lists of 200 short documents


def test_html_strict_and_regex_agree_on_simple_markup(spark):
    from tidings.functions.clean import html_to_text, html_to_text_strict, norm_space
    page = ('<html><head><style>p{x:1}</style><script>var t="</p>";</script></head><body>'
            '<!-- c --><h1>T &amp; U</h1><p>one<p>two &lt;b&gt;</p></body></html>')
    df = spark.createDataFrame([(page,)], "h string")
    r = df.select(norm_space(html_to_text("h")).alias("a"), norm_space(html_to_text_strict("h")).alias("b")).first()
    assert r["a"] == r["b"] == "T & Uonetwo <b>"


# ---- extraction / URLs ----------------------------------------------------------------
def test_day_url_builder(spark):
    """Port of the one upstream test: a date in, one listing URL out."""
    from tidings.functions.extract import day_url
    base = "https://news.example.com/feed/"
    df = spark.createDataFrame([(dt.date(2022, 1, 4),)], "d date")
    got = df.select(day_url("d", base).alias("u")).first()["u"]
    assert got == f"{base}business/?filterType=all&d=4&m=1&y=2022"


def test_crawl_plan_omits_zero_segments(spark):
    from tidings.functions.extract import crawl_plan
    p = spark.createDataFrame(
        [("https://s.example.com/q", "50", "desc", "0", "2", None, dt.date(2024, 1, 1), dt.date(2024, 1, 2))],
        "base string, size string, sort string, type string, bloc string, cursor string, start date, `end` date")
    urls = [r["url"] for r in crawl_plan(p).orderBy("day").collect()]
    assert urls == ["https://s.example.com/q?size=50&sort=desc&bloc=2&d=1&m=1&y=2024",
                    "https://s.example.com/q?size=50&sort=desc&bloc=2&d=2&m=1&y=2024"]


def test_resolve_urls_forms(spark):
    from tidings.functions.clean import resolve_url
    base = "https://a.example.com/x/y?q=1#f"
    refs = ["http://b.example.org/z", "//c.example.net/p", "/root", "?k=2", "#top", "", "rel/page"]
    df = spark.createDataFrame([(base, r) for r in refs], "b string, r string")
    got = [x["u"] for x in df.select(resolve_url("b", "r").alias("u")).collect()]
    assert got == ["http://b.example.org/z", "https://c.example.net/p", "https://a.example.com/root",
                   "https://a.example.com/x/y?k=2", "https://a.example.com/x/y?q=1#top",
                   "https://a.example.com/x/y?q=1", "https://a.example.com/x/rel/page"]


# ---- end to end on a hand-made corpus ---------------------------------------------------
def test_digest_on_handmade_corpus(spark):
    from tidings.plans import queries as Q
    base = dt.datetime(2024, 3, 1)
    rows = []
    titles = [("rates rise again at the central bank", 4), ("new tax rules for small firms", 3),
              ("port strike delays grain exports", 2)]
    i = 0
    for t, n in titles:
        for k in range(n):
            rows.append((i, f"https://x.example.com/{i}", "body", t, "s1", base - dt.timedelta(days=k), []))
            i += 1
    for extra in ["solo story one", "solo story two", "solo story three"]:
        rows.append((i, f"https://x.example.com/{i}", "body", extra, "s1", base - dt.timedelta(days=1), []))
        i += 1
    news = spark.createDataFrame(rows, "id long, link string, text string, title string, source string, "
                                       "timestamp timestamp_ntz, refers_to array<string>")
    roles = spark.createDataFrame([("r", ["s1"], [])], "role string, sources array<string>, add_okveds array<string>")
    out = Q.digest(spark, news, roles, "2024-03-01 00:00:00", "r", "all", None, days=7).collect()
    sizes = sorted((r["size"] for r in out), reverse=True)
    assert sizes == [4, 3, 2]
    assert {r["title"] for r in out} == {t for t, _ in titles}


def test_streaming_corpus_append(spark, tmp_path):
    from tidings.streaming.landing import stream_corpus
    land = tmp_path / "landing"
    land.mkdir()
    recs = spark.createDataFrame(
        [(f"https://x.example.com/{i}", "<p>t&amp;x</p>", f" title {i} ", "s", "2024-01-02T03:04:05", ["/a"])
         for i in range(5)], "link string, text string, title string, source string, timestamp string, "
                             "refers_to array<string>")
    recs.write.json(str(land / "batch1"))
    q = stream_corpus(spark, str(land), str(tmp_path / "table"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "table"))
    assert out.count() == 5
    r = out.orderBy("id").first()
    assert r["id"] == 0 and r["text"] == "t&x" and r["title"] == "title 0"
    assert r["refers_to"] == ["https://x.example.com/a"]


def brute_pairs(rows, t):
    d = cos_dist(rows)
    return {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(len(rows))
            if rows[i][0] < rows[j][0] and d[i, j] < t}


@pytest.mark.parametrize("block_rows", [2048, 8])
def test_similar_pairs_equal_brute_force(spark, block_rows):
    from tidings.operators import knn as K
    rows = planted(n_clusters=6, per=10, dims=8, noise=0.05, seed=21, singles=20)
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # copies
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    for t in (0.02, 0.2, 0.9):
        got = [(r["a"], r["b"]) for r in K.similar_pairs(df, t, block_rows=block_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, t)


def test_zero_vectors_have_no_pair(spark):
    from tidings.operators import knn as K
    from tidings.operators.cluster import cluster_complete, cluster_dbscan
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    assert [(r["a"], r["b"]) for r in K.similar_pairs(df, 0.9).collect()] == [(3, 4)]
    assert {r["id"]: r["label"] for r in cluster_complete(df, 0.5).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
    assert {r["id"]: r["label"] for r in cluster_dbscan(df, 0.5, 2).collect()} == {1: -1, 2: -1, 3: 3, 4: 3}


def test_groups_are_bounded_on_both_sides(spark):
    """All rows in one cell, and as many queries: no group holds more than ``block_rows``."""
    from tidings.operators import knn as K
    rows = spark.range(1000).selectExpr("7L AS cell", "id", "array(double(id)) AS vec")
    left, right = K.sub_blocks(rows, rows, "cell", 100)
    for side in (left, right):
        assert side.groupBy("cell", "li", "ri").count().agg(F.max("count")).first()[0] <= 100
    met = left.join(right.select("cell", "li", "ri", F.col("id").alias("nid")), ["cell", "li", "ri"])
    assert met.count() == met.select("id", "nid").distinct().count() == 1_000_000


def test_near_rows_equal_exact(spark):
    from tidings.operators import knn as K
    from tidings.plans import fixtures as X
    v = X.vectors(spark, SF_SMALL).select("id", "vec")
    exact = K.knn_exact(v, v, 20).where("dist < 1.3")
    key = lambda df: {(r["id"], r["nid"], r["rank"]) for r in df.collect()}
    assert key(K.near_rows(v, v, 20, 1.3, block_rows=40)) == key(exact)
    best = K.threshold_or_best_rows(v, v.where("id % 7 = 0"), 20, 1.2, block_rows=40)
    full = K.knn_exact(v, v.where("id % 7 = 0"), 20)
    assert key(best) == key(full.where("dist <= 1.2 or rank = 1"))


def test_importance_of_copies(spark):
    from tidings.operators import knn as K
    from tidings.operators.relational import importance
    rng = np.random.default_rng(2)
    rows = planted(n_clusters=3, per=6, dims=6, noise=0.1, seed=4)
    rows += [(300 + i, rows[0][1]) for i in range(20)]
    at = {r[0]: int(rng.integers(0, 12)) for r in rows}
    df = spark.createDataFrame([(i, v, dt.datetime(2024, 1, 1) + dt.timedelta(days=at[i])) for i, v in rows],
                               "id long, vec array<float>, timestamp timestamp_ntz")
    pairs, member = K.similar_classes(df, 0.3)
    got = {r["id"]: r["importance"] for r in importance(pairs, df, 3, member=member).collect()}
    want = dict.fromkeys(at, 0)
    for a, b in brute_pairs(rows, 0.3):
        if abs(at[a] - at[b]) <= 3:
            want[a] += 1
            want[b] += 1
    assert got == want


def test_index_store_is_read_with_its_centres(spark, tmp_path):
    from tidings.operators import knn as K
    from tidings.plans import fixtures as X
    from tidings.plans import queries as Q
    v = X.vectors(spark, SF_MID).select("id", "vec")
    vecs, centers, params = Q.build_index(v, str(tmp_path / "index"), 64)
    nlist = params.first()["nlist"]
    assert centers.count() == nlist and vecs.count() == v.count()
    exact = {(r["id"], r["nid"]) for r in K.knn_exact(v, v, 10).collect()}
    got = {(r["id"], r["nid"]) for r in K.knn_ivf(v, vecs, centers, 10, K.search_probes(nlist)).collect()}
    assert len(got & exact) / len(exact) >= 0.9
    one = vecs.where("cell = 3")
    assert "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().executedPlan().toString()
