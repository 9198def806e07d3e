"""Hand-written pages with expected results."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.markup import read_nodes
from gleaner.functions.nodes import render_html
from gleaner.operators import company, contacts, pages


def frame(spark, *htmls, url="https://h.com/a/b"):
    return spark.createDataFrame([(i, url, html) for i, html in enumerate(htmls)], "page_id bigint, url string, html string")


def test_tree_intervals():
    nodes = read_nodes("<div><p>a<b>c</p><br>d</div></i>e", "https://h.com/", False)
    assert [(n["tag"], n["node"], n["last"], n["parent"]) for n in nodes] == [
        ("div", 0, 6, -1), ("p", 1, 4, 0), ("#text", 2, 2, 1), ("b", 3, 4, 1), ("#text", 4, 4, 3), ("br", 5, 5, 0), ("#text", 6, 6, 0), ("#text", 7, 7, -1),
    ]


def test_base_tag_and_broken_links():
    html = '<base href="/x/"><a href="y">1</a><a href="http://[bad">2</a>'
    assert [n["href"] for n in read_nodes(html, "https://h.com/a", True) if n["tag"] == "a"] == ["https://h.com/x/y", None]


def test_render_gives_the_markup_back(spark):
    html = '<div class="a"><p>x &amp; <b>y</b></p><br/><script>1 < 2</script></div>'
    rows = pages.parse_pages(frame(spark, html)).select(render_html(F.col("nodes")).alias("h"))
    assert rows.first().h == html


def test_page_text_drops_scripts(spark):
    html = "<p> a </p><script>var t='</p>';</script><style>p{}</style><noscript>n</noscript><!-- c --><p>b&nbsp; c</p>"
    assert pages.page_text(frame(spark, html)).first().page_text == "a\nb c"


def test_job_links_by_selector_order_and_place(spark):
    html = """<head><a href="/jobs/0">head</a></head><div class="page-header"><a href="/jobs/9">no</a></div>
    <div class="job-card"><a href="/hiring/x">card</a></div><a href="/career">c</a><a href="/jobs/2?x=1">j</a><a href="/about">no</a>
    <span class="job-link" href="/position/3">s</span><footer><a href="/jobs/8">no</a></footer>
    <script>"https://h.com/X/Careers/jobs/77"</script>"""
    found = pages.job_links(frame(spark, html)).orderBy("place").collect()
    assert [r.url for r in found] == [
        "https://h.com/jobs/2?x=1", "https://h.com/career", "https://h.com/position/3", "https://h.com/hiring/x",
        "https://h.com/X/Careers/jobs/77", "https://h.com/jobs/0", "https://h.com/jobs/9", "https://h.com/jobs/2?x=1", "https://h.com/jobs/8",
    ]


def test_iframes(spark):
    html = '<iframe src="/careers/1"></iframe><iframe src="x"></iframe><iframe src="/careers/1"></iframe><iframe src="?embedded=true"></iframe>'
    assert [r.url for r in pages.job_iframes(frame(spark, html)).orderBy("pos").collect()] == ["https://h.com/careers/1", "https://h.com/a/b?embedded=true"]


def test_page_urls(spark):
    pager = '<div class="pagination"><a href="?page=2">2</a><a href="?page=3">3</a><a href="?page=2">2</a></div>'
    button = '<button aria-label="Go to next page">&gt;</button>'
    none = '<header><div class="pager"><a href="?page=2">2</a></div></header><a href="/x">x</a>'
    found = pages.page_urls(frame(spark, pager, button, none)).orderBy("listing_id", "pos").collect()
    assert [r.url for r in found if r.listing_id == 0] == ["https://h.com/a/b?page=2", "https://h.com/a/b?page=3"]
    assert [r.url for r in found if r.listing_id == 1] == [f"https://h.com/a/b?page={i}" for i in range(2, 11)]
    assert [r for r in found if r.listing_id == 2] == []


def cleaned(spark, *htmls, plain=False):
    return [r.html_content for r in pages.detail_html(frame(spark, *htmls), plain).orderBy("page_id").collect()]


def test_chrome_blocks_go_and_the_body_stays(spark):
    body = "<h2>Miner</h2><p>Job description: dig.</p>"
    html = f"""<body><main>{body}<div class="cookie-bar">c</div><div style="display:none">h</div><div id="asBranding">b</div>
    <div><div class="apply-button"><a>Apply</a></div><p>short wrapper</p></div><section><h3>Similar jobs</h3><a>x</a></section>
    <p><a>Apply now!</a> <a>Refer to a friend</a></p><ul><li><a>All jobs</a></li></ul></main></body>"""
    assert "".join(cleaned(spark, html)[0].split()) == "".join(f"<main>{body}</main>".split())


def test_long_body_is_not_climbed_into(spark):
    long = "<p>" + "Responsibilities and skills. " * 60 + "</p>"
    html = f'<body><div id="job">{long}<div><h3>Related jobs</h3></div><div class="x"><button>Apply</button></div></div></body>'
    found = cleaned(spark, html)[0]
    assert "Responsibilities" in found and "Related" not in found and "Apply" not in found


def test_main_content_variants(spark):
    html = '<body><header>h</header><div id="search-box">s</div><div class="content">c<p></p><p><img src="x"></p></div><article>a</article></body>'
    assert cleaned(spark, html) == ['<div class="content">c<p><img src="x"/></p></div>']
    assert cleaned(spark, html, plain=True) == ["<article>a</article>"]


def test_cleaning_that_leaves_nothing_keeps_the_main_part(spark):
    assert cleaned(spark, '<main class="cookie">x</main>') == ['<main class="cookie">x</main>']


HOME = """<div class="logobox"><img src="/l.png"></div><div id="middle"><h1>A</h1><h1 class="bold">Firm&nbsp;Ltd</h1>
<div class="n-anons"><img src=" "><img src="h.png">Maker <b>of</b> drills</div></div>
<ul class="tags"><li><a href="/t/x">Mining</a></li><li><a href="/t/deep%20well"></a></li><li>TAGS</li><li>mining</li></ul>
<div class="sectionBlock"><div class="tlt"><a href="s">Part</a></div><img src="i.png"></div>
<div class="sectionBlock"><div class="tlt"><a href="s">Part</a></div><img src="i.png"></div>
<div class="section-block"><p class="button"><a href="/go">x</a></p></div><div class="section-block"></div>"""


def test_company_home(spark):
    row = company.company_home(frame(spark, HOME)).first()
    assert row.company_logo == "https://h.com/l.png"
    assert row.company_name == "Firm Ltd"
    assert (row.hero_image, row.description) == (None, "Maker of drills")
    assert row.tags == ["Mining", "deep well"]
    assert [tuple(s) for s in row.sections] == [("Part", "https://h.com/a/i.png", "https://h.com/a/s"), (None, None, "https://h.com/go")]


def test_tags_from_plain_container_text(spark):
    assert company.company_home(frame(spark, '<div class="stage">Tags, a; B |a</div>')).first().tags == ["a", "B"]


def test_company_about(spark):
    html = '<base href="https://cdn.com/x/"><article>Text <img src="1.png"><img src="1.PNG"><img src="/2.png"></article>'
    row = company.company_about(frame(spark, html)).first()
    assert (row.images, row.description) == (["https://cdn.com/x/1.png", "https://cdn.com/2.png"], "Text")


def found_contacts(spark, html):
    return [r.asDict(recursive=True) for r in contacts.contact_records(frame(spark, html)).orderBy("pos").collect()]


def test_contact_boxes_with_person(spark):
    html = """<div class="contacts-box"><strong>North</strong><p>Unit 7</p><p>Vaughan ON L4K 1A1</p><p>Canada</p><p>Phone:</p><p>555-1</p>
    <div class="locationcontact">Contacts:<br>Ann Lee Tel:<br>9<br>ann@x.com</div></div><div class="contacts-box"> </div><table><tr><td>Phone</td><td>1</td></tr></table>"""
    (row,) = found_contacts(spark, html)
    assert (row["name"], row["address"], row["city"], row["state"], row["post_code"], row["country"], row["phone"]) == (
        "North", "Unit 7", "Vaughan", "ON", "L4K 1A1", "Canada", "555-1",
    )
    assert row["contact_person"] == {"name": "Ann Lee", "email": "ann@x.com", "phone": None, "telephone": "9", "fax": None}


def test_contact_tables_and_lowest_blocks(spark):
    html = """<table><tr><th>City</th><td>Oslo</td></tr><tr><td>city</td><td>Bergen</td></tr><tr><td>Tel</td><td>1</td></tr></table>
    <div class="contact"><div class="office-a">Plant A<br>Fax 2</div><div class="office-b">Plant B<br><a href="mailto:b@x.com?s=1">mail us</a> phone</div></div>
    <div class="contact"></div>"""
    rows = found_contacts(spark, html)
    assert [(r["city"], r["telephone"]) for r in rows[:1]] == [("Bergen", "1")]
    assert [(r["name"], r["fax"], r["mail"]) for r in rows[1:]] == [("Plant A", "2", None), ("Plant B", None, "us")]


def test_page_without_contacts(spark):
    assert found_contacts(spark, '<body><div class="contact"></div>nothing</body>') == []


def test_frames_are_told_by_their_full_address(spark):
    html = '<iframe src="frame.html"></iframe><iframe src="https://ads.com/x"></iframe><iframe src=""></iframe>'
    rows = spark.createDataFrame([(1, "https://x.com/careers/", html)], "page_id bigint, url string, html string")
    assert [r.url for r in pages.job_iframes(rows).collect()] == ["https://x.com/careers/frame.html"]


def test_hidden_containers_and_cdata(spark):
    html = "<p><ruby>K<rt>ka<b>deep</b></rt><rp>(</rp></ruby></p><template><p>hid</p></template><div><![CDATA[seen]]></div><p>end</p>"
    rows = spark.createDataFrame([(1, "https://x.com/", html)], "page_id bigint, url string, html string")
    assert pages.page_text(rows).first().page_text.split("\n") == ["K", "seen", "end"]


def test_cleaned_html_drops_stray_bytes(spark):
    rows = spark.createDataFrame([(1, "https://x.com/", "<main><p>PayÂ 10 Â nowÂ</p></main>")], "page_id bigint, url string, html string")
    assert "Â" not in pages.detail_html(rows).first().html_content


def test_deep_pages_take_linear_work():
    import time

    from gleaner.functions.chrome import mark_chrome

    took = []
    for depth in (1000, 4000):
        nodes = read_nodes("<div>" * depth + "<p>About the job</p>" * depth + "</div>" * depth, "https://h.com/", False)
        start = time.perf_counter()
        assert mark_chrome(nodes) == []
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * max(took[0], 0.02)


def test_blocks_are_removed_in_one_pass(spark):
    """Nested, repeated and unordered intervals against a plain loop, on whole pages and on runs of their nodes."""
    import random

    from gleaner.functions.nodes import outermost, outside, remove_spans

    rng = random.Random(8)
    rows = []
    for case in range(40):
        parts, depth = [], 0
        for _ in range(rng.randrange(30)):
            if depth and rng.random() < 0.5:
                parts.append("</div>")
                depth -= 1
            else:
                parts.append("<div>" if rng.random() < 0.7 else "x<br>")
                depth += parts[-1] == "<div>"
        nodes = read_nodes("".join(parts), "https://h.com/", False)
        roots = rng.choices(nodes, k=rng.randrange(6)) if nodes else []
        rows.append((case, "".join(parts), [(r["node"], r["last"]) for r in roots]))
    schema = "page_id int, html string, roots array<struct<node:int,last:int>>"
    parsed = pages.parse_pages(spark.createDataFrame([(i, h, r) for i, h, r in rows], schema).withColumn("url", F.lit("https://h.com/")))
    found = parsed.select(
        "page_id", "nodes", "roots", F.transform(remove_spans(F.col("nodes"), F.col("roots")), lambda n: n["live"]).alias("live"),
        F.transform(outside(F.col("nodes"), F.col("roots")), lambda n: n["node"]).alias("outside"), outermost(F.col("roots")).alias("outer"),
        F.transform(remove_spans(F.slice("nodes", 3, 9), F.filter("roots", lambda r: (r["node"] >= 2) & (r["last"] <= 10))), lambda n: n["live"]).alias("part"),
    ).collect()
    for r in found:
        held = [(a, b) for a, b in r.roots]
        n = len(r.nodes)
        assert r.live == [not any(a <= i <= b for a, b in held) for i in range(n)]
        assert r.outside == [i for i in range(n) if not any(a < i <= b for a, b in held)]
        assert [tuple(o) for o in r.outer] == sorted({(a, b) for a, b in held if not any((c, d) != (a, b) and c <= a and b <= d for c, d in held)})
        low = [(a, b) for a, b in held if a >= 2 and b <= 10]
        assert r.part == [not any(a <= i <= b for a, b in low) for i in range(2, min(n, 11))]


def test_removal_time_grows_with_nodes_plus_roots(spark):
    import time

    from gleaner.functions.nodes import remove_spans

    def seconds(n):
        html = "<p class='x'>a</p>" * n
        rows = pages.parse_pages(frame(spark, html))
        marked = rows.select(remove_spans(F.col("nodes"), F.transform(F.filter("nodes", lambda k: k["tag"] == "p"), lambda k: F.struct(k["node"].alias("node"), k["last"].alias("last")))).alias("m"))
        began = time.perf_counter()
        assert marked.select(F.size(F.filter("m", lambda k: k["live"]))).first()[0] == 0
        return time.perf_counter() - began

    seconds(500)
    small, large = min(seconds(2000) for _ in range(2)), min(seconds(8000) for _ in range(2))
    # Four times the nodes and four times the roots: sixteen times the work for a product of both.
    assert large < 8 * small + 1


def test_unknown_marked_sections_do_not_lose_a_page(spark):
    rows = frame(spark, "<![foo<p>lost</p>", "<p>a</p><![ x]><p>b</p>", "<![CDATA[kept]]><p>c</p>", "<![if IE]><p>d</p><![endif]>")
    assert [r.page_text for r in pages.page_text(rows).orderBy("page_id").collect()][:2] == ["lost", "a\nb"]
    assert pages.html_nodes(rows).select("page_id").distinct().count() == 4


def test_company_model_reads_whole_texts(spark):
    import json

    from gleaner.plans.company import profiles_with_model

    def last_line_model():
        def answer(prompt: str) -> str:
            last = prompt.rsplit("\n", 1)[-1]
            return json.dumps({"regions": [{"name": last}]} if "regions" in prompt.split("Page: ")[0] else {"description": last})

        return answer

    about, contact = (f"<p>{'filler words ' * 2_000}</p><p>{end}</p>" for end in ("The last of us.", "Last office"))
    row = (1, "https://h.com/", "<p>home</p>", "https://h.com/about", about, "https://h.com/contact", contact)
    columns = "company_id long, home_url string, home_html string, about_url string, about_html string, contact_url string, contact_html string"
    found = profiles_with_model(spark.createDataFrame([row], columns), last_line_model).first()
    assert (found.about.description, [r.name for r in found.regions]) == ("The last of us.", ["Last office"])
