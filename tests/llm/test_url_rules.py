import re

from skyledger.llm import url_rules

SCHEMA = "page_id long, url string, html string, token string, rule string, host string"
URLS = [
    "http://a.net/x", "https://example.net/en/1?q=/de/", "http://www.EXAMPLE.net/en/", "http://example.net/fr/en/", "http://myexample.com/de/1",
    "http://example.com/de/1", "http://m.example.com/de", "http://x.org/fr/1", "http://x.org#/fr/", "http://net", "http://net/", "no scheme", "", None,
    "ftp://a.b.net:80/", "http://example.net/en", "http://a.net/x", "HTTP://ORG/fr//x", "http://evil.org/fr\n/", "://net/", "http://x/http://y.net/", "http://.net/",
    "http://" + "a." * 20000 + "net/" + "p/" * 20000,
]


def brute(url, rules=url_rules.RULES):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "h", "t", "r", "o") for k, u in enumerate(URLS)] + [(0, URLS[0], "", "", "", "")], SCHEMA)
    out = url_rules.judge_urls(pages, url_rules.rules_frame(spark)).collect()
    assert len(out) == len(URLS) + 1
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id])


def test_rules_with_odd_characters_and_none_without_tokens(spark):
    rules = [("block", "a.b", "/x.y/(z"), ("block", "", "/only"), ("allow", "q\\E.com", "/"), ("block", "com", "/en")]
    urls = ["http://a.b/x.y/(z1", "http://a.b/xzy/(z1", "http://k/onlythis", "http://q\\E.com/", "http://c.com/english", ":///only/x", "http://a./only", ".only", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_rules.judge_urls(pages, url_rules.rules_frame(spark, rules), "block").collect():
        want = brute(urls[r.page_id], rules)
        if want[2] is None:
            want = (*want[:3], "block")
        assert (r.host, r.path, r.rule, r.verdict) == want


def test_rarest_token_is_the_index(spark):
    pages = spark.createDataFrame([(k, f"http://www.example.net/en/{k}") for k in range(9)] + [(9, "http://b.net/")], "page_id long, url string")
    tokens = spark.createDataFrame([("h:net", 10), ("h:example", 9), ("p:en", 3)], "token string, urls long")
    index = {r.rule: r.token for r in url_rules.rule_table(url_rules.rules_frame(spark), tokens).collect()}
    assert index["example.net/en/"] == "p:en" and index["net/"] == "h:net" and index["org/fr/"] in ("h:org", "p:fr")
    assert url_rules.judge_urls(pages, url_rules.rules_frame(spark)).where("rule = 'example.net/en/'").count() == 9


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge_urls(none, url_rules.rules_frame(spark)).count() == 0
    some = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    empty = url_rules.rules_frame(spark).where("false")
    assert [(r.rule, r.verdict) for r in url_rules.judge_urls(some, empty).collect()] == [(None, "allow")]
