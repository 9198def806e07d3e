from __future__ import annotations

import random
import time

import pytest

from gleaner.llm.main_text import _stretches, extract_main_text, main_text

LONG = "Some words of a paragraph that goes on for a while, as they do."
PAGES = {
    "named": (
        f'<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><article><header><h1>Head &amp; line</h1></header>'
        f'<p>{LONG}<div class="ad">Buy!</div><aside>Aside.</aside><p>Short.<br>After&nbsp;a  break<form>Name <input></form><section id="comments"><p>{LONG}</p></section><p>End.</article>'
        f"<footer>&copy; x</footer>",
        f"Head & line {LONG} Short. After a break End.",
    ),
    "unnamed": (
        f'<body><div class="site-header"><h1>Site</h1></div><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a><li><a>Four</a></ul><div id=content><h2>Title</h2><p>{LONG}</p>'
        f'<p><a href=x>All linked</a></p><div class="share">Share</div><p>{LONG}</p></div><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><div>Contact us</div></body>',
        f"Title {LONG} All linked {LONG}",
    ),
    "layout form": (f'<form action="/"><div class="no-sidebar"><h1>Title</h1><p>{LONG}</div><div class=sidebar>{LONG}</div></form>', f"Title {LONG}"),
    "comments as articles": (f"<main><p>{LONG}</main><article class='comment'><p>{LONG} No!</article>", LONG),
    "wrapped main": ('<div class="has-sidebar cookie-ok"><main>Tiny.</main></div><div>Other words.</div>', "Tiny."),
    "raw text": ('<article>a<script>var x = "</p><p>b";</script><style>c</style><!-- <p>d</p> --><noscript><p>e</p></noscript> f</article>', "a f"),
    "inline": ("<article>un<b>brok</b>en w&ouml;rd <i>x</i>&lt;y&gt; 1 < 2</article>", "unbroken wörd x<y> 1 < 2"),
    "wrong nesting": (f"<article><p><b>{LONG}<p>Two</b></i></p></span></div></article></b><p>Out", f"{LONG} Two"),
    "quotes": ("<article title='a > b' data-x=\"</article>\">In<p title=don't>side</article>out", "In side"),
    "cut in a tag": ("<article><p>Kept<p class='", "Kept"),
    "no markup": ("just words", "just words"),
    "furniture alone": ("<nav>Menu</nav><footer>Foot</footer>", ""),
    "nothing": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_page(name):
    html, wanted = PAGES[name]
    assert main_text(html) == wanted


def test_stretches_by_hand():
    rng = random.Random(5)
    import numpy as np

    for _ in range(300):
        weights = [rng.choice([0, 0, 0, 1, 7]) for _ in range(rng.randrange(25))]
        window = rng.randrange(1, 5)
        sums = [sum(weights[i : i + window]) for i in range(len(weights))]
        wanted, run = [], []
        for i, total in enumerate([*sums, 0]):
            if total:
                run.append(i)
            elif run:
                lines = [k for k in range(run[0], min(run[-1] + window, len(weights))) if weights[k]]
                wanted.append((lines[0], lines[-1], max(sums[k] for k in run)))
                run = []
        assert _stretches(np.array(weights, dtype=np.int64), window) == wanted


@pytest.mark.parametrize("piece", ["<a \"", "<a '", "<", "<div class=\"x", "<title>", "<p>x", "<!--", "</a", "<b x='>", "<article><nav>", "&am", "<textarea><noscript>"])
def test_time_grows_with_length(piece):
    began = time.perf_counter()
    main_text(piece * 100_000)
    assert time.perf_counter() - began < 10


def test_table_of_odd_rows(spark):
    rows = [(1, "u", PAGES["named"][0]), (1, "u", PAGES["named"][0]), (None, None, None), (2, None, ""), (3, "v", "<p>" + "wörd " * 200_000)]
    pages = spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = {(r.page_id, r.url, r.text, r.n_chars) for r in extract_main_text(pages).collect()}
    named = PAGES["named"][1]
    assert found == {(1, "u", named, len(named)), (None, None, "", 0), (2, None, "", 0), (3, "v", ("wörd " * 200_000).strip(), 999_999)}
    assert extract_main_text(pages).count() == 5
    assert extract_main_text(pages.limit(0)).count() == 0
