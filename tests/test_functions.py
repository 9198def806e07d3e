"""Literal rows with expected results."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import contacts as C
from gleaner.functions import geo as G
from gleaner.functions import markup
from gleaner.functions import text as T
from gleaner.functions import urls as U


def evaluate(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row.r for row in rows.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()]


def test_url_key(spark):
    cases = {
        "HTTPS://Ex.com/A/?x=1#f": "https://Ex.com/A/",
        "https://ex.com/OpportunityDetail?opportunityId=AB%2D1&z=2": "https://ex.com/OpportunityDetail?opportunityId=AB-1",
        "https://h.com/JB/OpportunityDetail?opportunityId=": "https://h.com/JB/OpportunityDetail",
        "https://h.com/JB?opportunityId=7": "https://h.com/JB",
        "http://[bad/x?y": "http://[bad/x",
        "ex.com/a?b": "ex.com/a",
        "": "",
    }
    keys = evaluate(spark, U.url_key, list(cases))
    assert keys == list(cases.values())
    assert evaluate(spark, U.url_key, keys)[0] == keys[0]


def test_url_key_agrees_with_the_standard_library(spark):
    import random
    from urllib.parse import parse_qs, urlsplit, urlunsplit

    def expected(url):
        parts = urlsplit(url)
        query = ""
        if "OpportunityDetail" in parts.path:
            chosen = parse_qs(parts.query).get("opportunityId")
            query = f"opportunityId={chosen[0]}" if chosen else ""
        return urlunsplit((parts.scheme, parts.netloc, parts.path, query, ""))

    draw = random.Random(5)
    heads = ["http://h.com", "HTTPS://H.com:80", "//h.com", "", "h.com", " http://u@h.com", "http://[::1]", "ht\ntp://h.com"]
    paths = ["", "/", "/a/b/", "/OpportunityDetail", "/x/OpportunityDetail/y", "/a b", "/a;p=1"]
    queries = ["", "?a=1", "?opportunityId=A%20b&c=1", "?x=1&opportunityId=&opportunityId=7", "?opportunityId=a+b", "?a#opportunityId=3"]
    tails = ["", "#f", "#f?q=1"]
    urls = ["".join(map(draw.choice, (heads, paths, queries, tails))) for _ in range(300)]
    assert evaluate(spark, U.url_key, urls) == [expected(url) for url in urls]


def test_absolute_url_agrees_with_the_standard_library(spark):
    from urllib.parse import urljoin

    base = "https://h.com/a/b/c?q=1#f"
    refs = ["x", "../x", "../../../x", "./x/./y", "/x/../y", "//o.com/z", "?p=2", "#t", "", "https://o.com/x?y", "x/", "..", "mailto:a@b.co", "g;x=1/../y"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(refs)], "i int, r string")
    found = [row.u for row in rows.select("i", U.absolute_url(F.lit(base), F.col("r")).alias("u")).orderBy("i").collect()]
    assert found == [urljoin(base, ref) for ref in refs]


LOCATIONS = {
    "Toronto, ON": ("Toronto", "Ontario", "Canada"),
    "San Diego, CA": ("San Diego", "California", "Canada"),
    "Denver, CO, USA": ("Denver", "Colorado", "United States"),
    "Val-d'Or": ("Val-d'Or", "Quebec", "Canada"),
    "Ontario": ("", "Ontario", "Canada"),
    "Remote - Austin, TX 78701": ("Austin", "Texas", "United States"),
    "Lima, Peru": ("Lima", "Peru", ""),
    "Sudbury, Ontario, Canada P3E 5P9": ("Sudbury", "Ontario", "Canada"),
    "Greater Sudbury, Lively, ON": ("Greater Sudbury", "Ontario", "Canada"),
    "Bldg 4, Lively, Ontario": ("Lively", "Ontario", "Canada"),
    "Hybrid, Chicago": ("Chicago", "Illinois", "United States"),
    "Vancouver, U.S.": ("Vancouver", "U.S.", "Canada"),
    "": ("", "", ""),
}


def test_standardize_location(spark):
    rows = spark.createDataFrame([(raw, raw) for raw in LOCATIONS], "raw string, location string")
    found = {r.raw: r for r in G.standardize_location(rows).collect()}
    for raw, expected in LOCATIONS.items():
        row = found[raw]
        assert (row.city, row.state, row.country) == expected, raw
        assert row.location == ", ".join(part for part in expected if part)


def test_region_filter(spark):
    cases = {"Perth, Australia": True, "Rio de Janeiro": True, "Lyon, France": False, "Berlin": False, "Reno, NV": True, "": False}
    assert evaluate(spark, G.is_canada_us, list(cases)) == list(cases.values())
    words = evaluate(spark, lambda c: G.is_canada_us(c, "word"), ["Perth, Australia", "Taipei", "Toronto"])
    assert words == [False, False, True]


def test_label_lines(spark):
    lines = ["Phone:", "Fax:", "555-1", "Email", "a@b.co", "Tel"]
    assert evaluate(spark, C.pair_label_lines, [lines, [], ["Tel"]], "array<string>") == [
        ["Phone: Fax:", "555-1", "Email a@b.co", "Tel"], [], ["Tel"],
    ]


def test_labeled_value(spark):
    cases = {
        "Telephone: 555": ("telephone", "555"),
        "Television Road": ("telephone", "evision Road"),
        "Cellar Lane": ("phone", "ar Lane"),
        "Mailing address: 5 St": ("mail", "ing address: 5 St"),
        "Regional office": ("name", "al office"),
        "Zip code: 9": ("post_code", "code: 9"),
        "hello": None,
    }
    assert [r and tuple(r) for r in evaluate(spark, C.labeled_value, list(cases))] == list(cases.values())


def test_city_lines(spark):
    found = evaluate(spark, C.parse_city_state_post, ["Vaughan ON L4K 1A1", "Reno, NV 89501", "Toronto, ON, M5V 2T6"])
    assert [f and tuple(f) for f in found] == [("Vaughan", "ON", "L4K 1A1"), ("Reno", "NV", "89501"), None]
    three = evaluate(spark, C.parse_city_state_country, ["Toronto, ON, M5V 2T6", "a, b"])
    assert [f and tuple(f) for f in three] == [("Toronto", "ON", "M5V 2T6"), None]


@pytest.mark.parametrize(
    "function, cases",
    [
        (T.first_int, {"5-7 years": 5, "none": 0, "": 0, "99999999999": 0}),
        (T.strip_code_fence, {"```json\n{}\n```": "{}", "```\nx```": "x", "x": "x"}),
        (T.normalize_space, {" a \t b\n": "a b"}),
        (T.display_text, {"": "N/A", "x" * 101: "x" * 100 + "...", "ab": "ab"}),
        (C.extract_email, {"write a.b@c-d.org now": "a.b@c-d.org", "none": None}),
        (C.looks_like_phone, {"(705) 692-3333 ext 4": True, "call 5": False, "x": False}),
        (C.contact_label, {"Postal-Code": "post_code", "E-Mail": "mail", "City": "city", "Hours": None}),
        (U.mailto_address, {"mailto:a@b.co?subject=x": "a@b.co"}),
        (U.tag_from_href, {"/tags/deep%20mining/": "deep mining", "/a+b?x": "a+b", "https://h.com": None}),
        (U.is_job_url, {"https://h.com/x?id=4": True, "https://h.com/hiring": True, "https://h.com/about": False}),
    ],
)
def test_scalar(spark, function, cases):
    assert evaluate(spark, function, list(cases)) == list(cases.values())


def test_deadline(spark):
    run = datetime(2024, 6, 1, 12)
    found = evaluate(spark, lambda c: T.deadline_or_default(c, run), ["2024-02-30", "May 5, 2024", "March 7, 2024", "soon", None, "12/31/2024"])
    default = datetime(2024, 7, 1, 12)
    assert found == [default, datetime(2024, 5, 5), datetime(2024, 3, 7), default, default, datetime(2024, 12, 31)]


def test_embedded_json_link(spark):
    html = '{"u":"https:\\/\\/h.com\\/X\\/Careers\\/jobs\\/11"}'
    found = evaluate(spark, lambda c: U.detail_urls(c, F.lit("https://p.com/")), [html])
    assert found == [["https://h.com/X/Careers/jobs/11"]]


def test_person_fields(spark):
    cases = [
        (["Contacts", "Bob Tel:", "123", "mobile", "456", "b@c.de"], ("Bob", "b@c.de", "456", "123", None)),
        (["Ann Lee", "phone:", "555", "fax", "9"], ("Ann Lee", None, "555", None, "9")),
        (["Eve phone: 1", "Tel 2"], ("Eve", None, "1", "2", None)),
        (["555-1"], (None, None, None, None, None)),
    ]
    found = evaluate(spark, C.person_fields, [lines for lines, _ in cases], "array<string>")
    assert [tuple(f) for f in found] == [expected for _, expected in cases]


def test_nodes_of_a_batch_come_in_bounded_runs():
    page = "<p>" + "word " * 2_000 + "</p>"
    htmls, urls = pa.array([page, None, "", page + page * 30] + [page] * 200), pa.array(["https://a.example.com/"] * 204)
    runs = list(markup.node_runs(iter([(htmls, urls), (htmls.slice(0, 0), urls.slice(0, 0))]), False))
    assert len(runs) > 10 and max(len(run) for run in runs) < 25
    expected = [markup.read_nodes(html, "https://a.example.com/", False) for html in htmls.to_pylist()]
    found = [nodes for run in runs for nodes in run.to_pylist()]
    assert [[(n["tag"], n["text"], n["last"]) for n in nodes] for nodes in found] == [[(n["tag"], n["text"], n["last"]) for n in nodes] for nodes in expected]
