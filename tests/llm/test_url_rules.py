import random
import re

import pytest

from tidings.llm import url_rules as U


def brute(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, default))
    return host, path, best[1], best[2]


def check(spark, urls, rules, parts):
    pages = spark.createDataFrame([(i, u, 7) for i, u in enumerate(urls)], "page_id long, url string, rule int")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = {r.page_id: tuple(r)[1:] for r in U.judge_urls(pages, table, parts=parts).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


AWKWARD = [None, "", "no scheme", "http://", "https://COM", "https://com/", "http://a.Example.com/en/x?y://z",
           "http://www.example.com/en", "http://www.example.com/en/", "http://xexample.com/en/", "http://x.net/fr/#t",
           "http://example.com?x/en/", "http://example.com:80/en/", "http://u@example.com/en/", "http://a..com/",
           "http://.com/", "http://" + "a." * 3000 + "com/" + "x" * 5000, "x\ny://example.com/en/\nz"]


@pytest.mark.parametrize("parts", [1, 5])
def test_contract_rules(spark, parts):
    check(spark, AWKWARD + ["https://hot.net/es/1"] * 50, list(U.RULES), parts)


def test_many_nested_rules(spark):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "x", "y"]) for _ in range(rng.randint(0, 5)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in
                  ((host(), "/" + path()) for _ in range(150))}.values())
    check(spark, [f"http://{host()}/{path()}" for _ in range(600)], rules, 7)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = U.rule_table(spark).limit(0)
    assert [tuple(r) for r in U.judge_urls(pages, none).collect()] == [(1, "a.com", "/", None, "allow")]
    assert U.judge_urls(pages.limit(0), U.rule_table(spark)).collect() == []
