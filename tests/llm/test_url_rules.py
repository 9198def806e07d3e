from __future__ import annotations

from gleaner.llm.url_rules import judge_urls

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
    ("b.net", "", "block"), ("a.b.net", "/e", "allow"), ("a.b.net", "/en/x", "block"), ("example.com", "/en/deep/", "allow"), ("Org", "/", "block"), ("", "/", "block"),
]
URLS = [
    "http://WWW.Example.com/en/x?q=/", "https://example.com/en/", "https://notexample.com/en/", "http://x.net/es/1", "http://x.net/esp", "http://net/fr/#a", "http://a.com",
    "http://a.com?x=/", "http://a.com/#", "ftp://c.a.b.net/en/x/y", "ftp://a.b.net/en", "ftp://b.net", "http://z.example.com/en/deep/1", "example.com/en/", "", None, "://", "://x", "http://u.org/",
    "http://com:80/", "http://a.example.com./en/", "a://b://c.com/", "http://ÉX.com/", "http://a.com/en/" + "x" * 5000,
]


def judged(url, rules):
    at = url.find("://") if url else -1
    rest = url[at + 3 :] if at >= 0 else ""
    rest = rest.split("#")[0].split("?")[0]
    host, slash, tail = rest.partition("/")
    host, path = "".join(c.lower() if c < "\x7f" else c for c in host), slash + tail
    fit = [(len(h) + len(p), len(h), h.lower() + p, v) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    return (host, path, *((max(fit)[2:]) if fit else (None, "allow")))


def test_rules_against_each_url(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = [(k % 20, u, "clash", "clash") for k, u in enumerate(URLS * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    found = [(r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules).collect()]
    wanted = [(k, u, *judged(u, RULES)) for k, u, *_ in rows]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert [r.verdict for r in judge_urls(pages, rules.limit(0), "block").collect()] == ["block"]


def test_native(spark):
    from gleaner.llm.queries import QUERIES

    plan = QUERIES["op2_url_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
