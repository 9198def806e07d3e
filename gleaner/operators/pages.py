"""Jobs over parsed pages. A page stays one row until its results are listed, so nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.chrome import chrome_roots
from gleaner.functions.markup import parse_nodes
from gleaner.functions.nodes import (
    attr,
    clean_text,
    descendants,
    find,
    find_all,
    has_attr,
    has_class,
    id_and_class,
    inside,
    inside_any,
    is_element,
    keep_span,
    outermost,
    outside,
    remove,
    remove_spans,
    render_html,
    spans,
    text_pieces,
)
from gleaner.functions.staging import settled
from gleaner.functions.text import blank_to_null, dedupe_ci, fix_mojibake, let, normalize_space, split_lines, strip_space
from gleaner.functions.urls import detail_url_filter, detail_urls, is_job_url, numbered_page_urls, tag_from_href

SILENT_TAGS = ("script", "style", "noscript")


def parse_pages(pages: DataFrame, use_base: bool = False, out: str = "nodes") -> DataFrame:
    """Add the node array of every page; the only Python step."""
    return pages.withColumn(out, parse_nodes(F.col("html"), F.col("url"), use_base))


def html_nodes(pages: DataFrame) -> DataFrame:
    """One row per node, with its interval and its own text."""
    # The outer form: for the plain one Spark adds a filter on the array, and parses every page twice.
    rows = parse_pages(pages).select("page_id", F.inline_outer("nodes"))
    return rows.filter(F.col("node").isNotNull()).select(
        "page_id", "node", "parent", F.col("node").alias("pre"), F.col("last").alias("post"), "depth", "tag", "attrs",
        F.col("text").alias("own_text"), F.col("href").alias("abs_href"), F.col("src").alias("abs_src"),
    )


def page_lines(nodes: Column) -> Column:
    """Visible text of a page as lines."""
    return split_lines(F.array_join(text_pieces(remove(nodes, lambda n: n["tag"].isin(*SILENT_TAGS))), "\n"))


def page_text(pages: DataFrame, preserve_lines: bool = True, out: str = "page_text") -> DataFrame:
    text = F.array_join(page_lines(F.col("nodes")), "\n")
    text = text if preserve_lines else normalize_space(text)
    return parse_pages(pages).withColumn(out, text).drop("nodes")


def job_text(pages: DataFrame, out: str = "job_text") -> DataFrame:
    """Text given to the extraction model: scripts and page chrome removed."""
    parsed = parse_pages(pages)
    quiet = parsed.withColumn("nodes", remove(F.col("nodes"), lambda n: n["tag"].isin("script", "style")))
    return strip_page_chrome(quiet).withColumn(out, F.array_join(text_pieces(F.col("nodes")), "\n")).drop("nodes")


# --- links -----------------------------------------------------------------------------------

# Link selectors in order of trust. Each takes a node and the named holder spans.
HOLDER_CLASSES = {
    "job_title": ("job-title",),
    "position_title": ("position-title",),
    "job_card": ("job-card",),
    "job_item": ("job-item",),
    "listing_item": ("listing-item",),
    "job": ("job",),
    "jobs": ("jobs",),
    "listing": ("listing",),
    "position": ("position",),
}


def _link_rank(node: Column, holders: Column) -> Column:
    """Number of the first link selector the node fits, NULL when it fits none."""
    anchor = node["tag"] == "a"
    href, test_id = attr(node, "href"), attr(node, "data-testid")

    def href_has(text: str) -> Column:
        return anchor & F.contains(href, F.lit(text))

    def below(name: str) -> Column:
        return anchor & inside_any(node, holders[name])

    selectors = [
        href_has("/Careers/jobs/"),
        href_has("/careers/jobs/"),
        href_has("/jobs/"),
        href_has("/job/") & href_has("/Careers/"),
        href_has("OpportunityDetail"),
        href_has("/JobBoard/"),
        anchor & (attr(node, "data-automation") == "job-title"),
        anchor & has_class(node, "opportunity-link"),
        anchor & has_class(node, "jobCardTitle") & has_class(node, "JobsList_jobCardTitle__pRNjw"),
        anchor & F.startswith(test_id, F.lit("jobCardTitle_")),
        has_class(node, "JobsList_jobCardTitle__pRNjw"),
        anchor & has_class(node, "jobCardTitle"),
        anchor & F.contains(attr(node, "class"), F.lit("jobCardTitle")),
        anchor & F.contains(test_id, F.lit("jobCardTitle")),
        anchor & F.startswith(href, F.lit("/job/")),
        href_has("/job/"),
        href_has("job"),
        href_has("career"),
        href_has("vacancy"),
        href_has("position"),
        below("job_title"),
        has_class(node, "job-link"),
        below("position_title"),
        below("job_card"),
        below("job_item"),
        below("listing_item"),
        below("job_id"),
        below("job_testid"),
        anchor & F.contains(test_id, F.lit("jobCard")),
        below("job"),
        below("jobs"),
        below("listing"),
        below("position"),
        anchor & F.contains(F.lower(attr(node, "aria-label")), F.lit("job")),
        anchor & F.contains(F.lower(attr(node, "title")), F.lit("job")),
    ]
    rank = None
    for number, fits in enumerate(selectors):
        rank = F.when(fits, F.lit(number)) if rank is None else rank.when(fits, F.lit(number))
    return rank


PATTERN_RANK = 35


def _edge_named(node: Column) -> Column:
    return id_and_class(node).rlike("header|footer")


def exclude_under_header_footer(nodes: Column) -> Column:
    """Drop the nodes with an ancestor whose id or class names a header or footer."""
    return let(nodes, lambda page: let(spans(page, _edge_named), lambda edges: outside(page, edges)))


def page_links(nodes: Column) -> Column:
    """All anchors with a target outside head, footer and anything named header or footer."""
    cut = remove(nodes, lambda n: n["tag"].isin("head", "footer"))
    return find_all(exclude_under_header_footer(cut), lambda n: (n["tag"] == "a") & n["href"].isNotNull())


def _job_link_structs(nodes: Column, html: Column, url: Column) -> Column:
    def ranked(page: Column) -> Column:
        holders = F.struct(
            *[outermost(spans(page, lambda n, c=c: has_class(n, *c))).alias(name) for name, c in HOLDER_CLASSES.items()],
            outermost(spans(page, lambda n: has_attr(n, "data-job-id"))).alias("job_id"),
            outermost(spans(page, lambda n: F.contains(attr(n, "data-testid"), F.lit("job")))).alias("job_testid"),
        )

        def links_of(held: Column) -> Column:
            placed = F.transform(
                find_all(exclude_under_header_footer(page), lambda n: n["href"].isNotNull() & is_job_url(n["href"])),
                lambda n: F.struct(
                    _link_rank(n, held).alias("rank"), n["node"].alias("pos"), n["href"].alias("url")
                ),
            )
            return F.filter(placed, lambda link: link["rank"].isNotNull())

        return let(holders, links_of)

    selected = let(remove(nodes, lambda n: n["tag"].isin("head", "footer")), ranked)
    patterns = F.transform(
        detail_url_filter(detail_urls(html, url)),
        lambda found, i: F.struct(F.lit(PATTERN_RANK).alias("rank"), i.alias("pos"), found.alias("url")),
    )
    return F.concat(selected, patterns)


def job_links(pages: DataFrame, listing: str = "page_id") -> DataFrame:
    """Links to job pages, ranked by the selector that found them, then those named in the raw html.

    ``place`` orders the links of a chunk. ``chunk_no`` tells the documents of one listing apart.
    """
    chunk = F.col("chunk_no") if "chunk_no" in pages.columns else F.lit(0)
    structs = _job_link_structs(F.col("nodes"), F.col("html"), F.col("url"))
    listed = parse_pages(pages).select(F.col(listing).alias("listing_id"), chunk.alias("chunk_no"), F.inline(structs))
    return listed.select("listing_id", "chunk_no", F.struct("rank", "pos").alias("place"), "url")


def job_iframes(pages: DataFrame, listing: str = "page_id") -> DataFrame:
    """Sources of iframes that hold listings, each once per page; the full address tells, not the source as written."""
    words = "|".join(K.JOB_IFRAME_WORDS)
    frames = find_all(F.col("nodes"), lambda n: (n["tag"] == "iframe") & (strip_space(attr(n, "src")) != "") & F.lower(n["src"]).rlike(words))
    urls = F.array_distinct(F.transform(frames, lambda n: n["src"]))
    return parse_pages(pages).select(F.col(listing).alias("listing_id"), F.posexplode(urls).alias("pos", "url"))


def _is_pager(node: Column, holders: Column, text_of) -> Column:
    tag, label, test_id = node["tag"], attr(node, "aria-label"), attr(node, "data-testid")
    button, anchor = tag == "button", tag == "a"
    with_target = (
        (anchor & inside_any(node, holders))
        | (anchor & F.contains(attr(node, "href"), F.lit("page")))
        | has_class(node, "next-page")
        | (attr(node, "rel").rlike(r"^next$"))
        | has_class(node, "Paginator_btn__KRVdV")
        | F.contains(F.lower(label), F.lit("next"))
    )
    by_button = button & (
        (test_id == "goToNextPageBtn")
        | (label == "Go to next page")
        | F.startswith(test_id, F.lit("goToPage"))
        | F.contains(test_id, F.lit("nextPage"))
        | F.contains(F.lower(label), F.lit("next page"))
        | F.lower(attr(node, "class")).rlike("next")
    )
    by_text = (button & F.contains(text_of(node), F.lit("Next"))) | (
        anchor & (attr(node, "href") != "") & text_of(node).rlike("Next|>")
    )
    return by_button | by_text | (with_target & (button | (attr(node, "href") != "")))


def page_urls(pages: DataFrame, listing: str = "page_id", max_pages: int = 10) -> DataFrame:
    """Further pages of a listing that shows a pager: its numbered links, else guessed addresses."""
    quiet = remove(
        F.col("nodes"), lambda n: n["tag"].isin("head", "header", "footer") | (is_element(n) & _edge_named(n))
    )

    def of_page(page: Column) -> Column:
        holders = spans(page, lambda n: has_class(n, "pagination", "pager", "page-numbers"))

        def urls_of(held: Column) -> Column:
            text_of = lambda n: F.array_join(text_pieces(descendants(page, n)), " ")
            pager = F.exists(page, lambda n: n["live"] & is_element(n) & _is_pager(n, held, text_of))
            numbered = find_all(page, lambda n: (n["tag"] == "a") & attr(n, "href").rlike(r"page=\d+|p=\d+"))
            links = F.array_distinct(F.transform(numbered, lambda n: n["href"]))
            links = F.filter(links, lambda url: url != F.col("url"))
            urls = F.when(F.size(links) > 0, links).otherwise(numbered_page_urls(F.col("url"), max_pages))
            return F.when(pager, F.slice(urls, F.lit(1), F.lit(max_pages - 1))).otherwise(F.array().cast("array<string>"))

        return let(holders, urls_of)

    return parse_pages(pages).select(
        F.col(listing).alias("listing_id"), F.posexplode(let(quiet, of_page)).alias("pos", "url")
    )


# --- detail html -----------------------------------------------------------------------------


def strip_page_chrome(pages: DataFrame, nodes: str = "nodes") -> DataFrame:
    """Take branding, cookie, hidden, apply and related-job blocks off the pages."""
    marked = settled(pages, {nodes: F.col(nodes)}).withColumn("_roots", chrome_roots(F.col(nodes)))
    kept = F.when(F.col("_roots").isNotNull(), remove_spans(F.col(nodes), F.col("_roots"))).otherwise(F.col(nodes))
    return marked.withColumn(nodes, kept).drop("_roots")


def drop_empty_paragraphs(nodes: Column) -> Column:
    """Take off paragraphs without text and without anything to show."""

    def of_page(page: Column) -> Column:
        def shows(n: Column) -> Column:
            media = n["tag"].isin("img", "video", "iframe", "object", "embed", "br")
            return n["live"] & (media | ((n["tag"] == "#text") & (strip_space(n["text"]) != "")))

        return remove(page, lambda n: (n["tag"] == "p") & ~F.exists(descendants(page, n), shows))

    return let(nodes, of_page)


def _main_rank(node: Column, plain: bool) -> Column:
    by_class = lambda *names: has_class(node, *names)
    by_id = lambda name: attr(node, "id") == name
    start = [node["tag"] == "main", attr(node, "role") == "main"]
    if plain:
        selectors = start + [
            by_class("job-content"), by_class("job-details"), by_class("job-description"), by_id("job-content"),
            by_class("jobDisplayShell"), by_class("job-posting"), by_class("job-detail"), node["tag"] == "article",
        ]
    else:
        selectors = start + [
            by_class("main-content"), by_class("content"), by_class("job-content"), by_class("job-details"),
            by_class("job-description"), by_id("main"), by_id("content"), by_id("job-content"),
            by_class("jobDisplayShell"), by_class("job-posting"), by_class("job-detail"),
        ]
    selectors.append(node["tag"] == "body")
    rank = None
    for number, fits in enumerate(selectors):
        rank = F.when(fits, F.lit(number)) if rank is None else rank.when(fits, F.lit(number))
    return rank


def main_content(nodes: Column, plain: bool = False) -> Column:
    """Keep the part of a page that holds its content, else the body, else everything."""
    if plain:
        quiet = remove(nodes, lambda n: n["tag"].isin(*SILENT_TAGS, "header", "footer"))
    else:
        quiet = remove(
            nodes,
            lambda n: n["tag"].isin("header", "footer")
            | (is_element(n) & id_and_class(n).rlike("header|footer|search")),
        )

    def of_page(page: Column) -> Column:
        ranked = F.transform(
            find_all(page, lambda n: _main_rank(n, plain).isNotNull()),
            lambda n: F.struct(_main_rank(n, plain).alias("rank"), n["node"].alias("node"), n["last"].alias("last")),
        )
        return let(F.array_min(ranked), lambda root: F.when(root.isNull(), page).otherwise(keep_span(page, root)))

    return let(quiet, of_page)


def detail_html(pages: DataFrame, plain: bool = False, out: str = "html_content") -> DataFrame:
    """Cleaned html of a detail page; the uncleaned main part where cleaning leaves nothing. Stray bytes of double encoding go first."""
    return _clean_html(parse_pages(pages.withColumn("html", fix_mojibake(F.col("html")))), plain, out).drop("nodes")


def _clean_html(parsed: DataFrame, plain: bool, out: str, nodes: str = "nodes") -> DataFrame:
    """Add the cleaned html of a node array."""
    main = parsed.withColumn("_main", main_content(F.col(nodes), plain))
    cleaned = strip_page_chrome(main.withColumn("_clean", F.col("_main")), "_clean")
    shown = settled(cleaned, {"_html": render_html(drop_empty_paragraphs(F.col("_clean")))}).drop("_clean")
    return shown.withColumn(
        out, F.when(strip_space(F.col("_html")) != "", F.col("_html")).otherwise(render_html(F.col("_main")))
    ).drop("_main", "_html")


def job_details(pages: DataFrame, text_out: str = "page_text", html_out: str | None = "html_content", plain: bool = False) -> DataFrame:
    """The text for the extraction model and, if named, the cleaned html of detail pages, from one node array.

    Pages with stray bytes of double encoding, which the html leaves out and the text keeps, are the only ones parsed for each.
    """
    parsed = parse_pages(pages)
    if html_out:
        fixed = fix_mojibake(F.col("html"))
        again = parse_nodes(F.when(fixed != F.col("html"), fixed), F.col("url"))
        both = parsed.withColumn("_again", again).withColumn("_fixed", F.when(fixed != F.col("html"), F.col("_again")).otherwise(F.col("nodes"))).drop("_again")
        parsed = _clean_html(settled(both, {"_fixed": F.col("_fixed")}), plain, html_out, "_fixed").drop("_fixed")
    quiet = parsed.withColumn("nodes", remove(F.col("nodes"), lambda n: n["tag"].isin("script", "style")))
    return strip_page_chrome(quiet).withColumn(text_out, F.array_join(text_pieces(F.col("nodes")), "\n")).drop("nodes")


# --- company pages ---------------------------------------------------------------------------


def middle_block(nodes: Column) -> Column:
    """The content block of a company page."""
    by_id = lambda name: find(nodes, lambda n: attr(n, "id") == name)
    return F.coalesce(by_id("middle 2"), by_id("middle2"), by_id("middle"))


def _filled(node: Column, name: str) -> Column:
    """Trimmed attribute, NULL when blank."""
    return blank_to_null(strip_space(attr(node, name)))


def _target(node: Column, name: str, resolved: str) -> Column:
    return F.when(_filled(node, name).isNotNull(), node[resolved])


def _first_image(nodes: Column) -> Column:
    image = find(nodes, lambda n: (n["tag"] == "img") & has_attr(n, "src"))
    return let(image, lambda n: _target(n, "src", "src"))


def company_home_fields(nodes: Column) -> Column:
    """Struct of logo, name, hero image and description."""

    def of_main(page: Column, main: Column) -> Column:
        body = descendants(page, main)
        part = F.when(main.isNull(), page).otherwise(body)
        hero = F.coalesce(find(part, lambda n: has_class(n, "n-anons")), find(page, lambda n: has_class(n, "n-anons")))
        heading = F.coalesce(
            find(part, lambda n: (n["tag"] == "h1") & has_class(n, "bold")),
            find(part, lambda n: n["tag"] == "h1"),
            find(page, lambda n: n["tag"] == "h1"),
        )
        logo = find(page, lambda n: has_class(n, "logobox"))
        return F.struct(
            let(logo, lambda n: _first_image(descendants(page, n))).alias("company_logo"),
            let(heading, lambda n: clean_text(descendants(page, n))).alias("company_name"),
            let(hero, lambda n: _first_image(descendants(page, n))).alias("hero_image"),
            let(hero, lambda n: clean_text(descendants(page, n))).alias("description"),
        )

    return let(nodes, lambda page: let(middle_block(page), lambda main: of_main(page, main)))


def company_tags(nodes: Column) -> Column:
    """Distinct tags of a page; until some tag is found, a container's own text is split up."""

    def is_container(n: Column) -> Column:
        named = F.contains(attr(n, "class"), F.lit("tag")) | F.contains(attr(n, "id"), F.lit("tag"))
        by_rel = (n["tag"] == "a") & attr(n, "rel").rlike(r"(?:^|\s)tag(?:\s|$)")
        return is_element(n) & (named | by_rel)

    def of_page(page: Column) -> Column:
        def label(n: Column) -> Column:
            return F.coalesce(clean_text(descendants(page, n)), tag_from_href(_filled(n, "href")))

        def of_container(box: Column) -> Column:
            holders = F.filter(
                F.concat(F.array(box), descendants(page, box)), lambda n: n["live"] & n["tag"].isin("a", "span", "li")
            )
            labels = F.filter(F.transform(holders, label), lambda t: t.isNotNull() & (F.lower(t) != "tags"))
            text = clean_text(descendants(page, box))
            pieces = F.filter(
                F.transform(F.split(F.coalesce(text, F.lit("")), r"[,|;/\n]+"), strip_space),
                lambda t: (t != "") & (F.lower(t) != "tags"),
            )
            return F.struct(labels.alias("labels"), pieces.alias("pieces"))

        def of_boxes(boxes: Column) -> Column:
            first = F.get(F.filter(boxes, lambda b: (F.size(b["labels"]) > 0) | (F.size(b["pieces"]) > 0)), F.lit(0))
            none = F.array().cast("array<string>")
            pieces = F.when(first.isNotNull() & (F.size(first["labels"]) == 0), first["pieces"]).otherwise(none)
            return dedupe_ci(F.concat(pieces, F.flatten(F.transform(boxes, lambda b: b["labels"]))))

        return let(F.transform(find_all(page, is_container), of_container), of_boxes)

    return let(nodes, of_page)


def company_sections(nodes: Column) -> Column:
    """Distinct section blocks as structs of title, image and url."""

    def of_page(page: Column) -> Column:
        def with_spans(held: Column) -> Column:
            def of_block(block: Column) -> Column:
                body = descendants(page, block)
                title_link = find(body, lambda n: (n["tag"] == "a") & inside_any(n, held["titles"]))
                title = F.coalesce(title_link, find(body, lambda n: has_class(n, "tlt")))
                button = find(body, lambda n: (n["tag"] == "a") & inside_any(n, held["buttons"]))
                any_link = find(body, lambda n: (n["tag"] == "a") & has_attr(n, "href"))
                target = lambda link: let(link, lambda n: _target(n, "href", "href"))
                return F.struct(
                    let(title, lambda n: clean_text(descendants(page, n))).alias("title"),
                    _first_image(body).alias("image"),
                    F.coalesce(target(title_link), target(button), target(any_link)).alias("url"),
                )

            blocks = find_all(page, lambda n: has_class(n, "sectionBlock", "section-block"))
            rows = F.filter(
                F.transform(blocks, of_block), lambda s: F.coalesce(s["title"], s["image"], s["url"]).isNotNull()
            )
            return F.array_distinct(rows)

        held = F.struct(
            spans(page, lambda n: has_class(n, "tlt")).alias("titles"),
            spans(page, lambda n: has_class(n, "button")).alias("buttons"),
        )
        return let(held, with_spans)

    return let(nodes, of_page)


def company_about_fields(nodes: Column) -> Column:
    """Struct of distinct images and the description of an about page."""

    def of_page(page: Column) -> Column:
        content = F.coalesce(
            find(page, lambda n: has_class(n, "n-anons")),
            middle_block(page),
            find(page, lambda n: n["tag"] == "article"),
            find(page, lambda n: n["tag"] == "main"),
            find(page, lambda n: n["tag"] == "body"),
        )

        def of_content(root: Column) -> Column:
            part = F.when(root.isNull(), page).otherwise(descendants(page, root))
            images = F.transform(find_all(part, lambda n: n["tag"] == "img"), lambda n: _target(n, "src", "src"))
            return F.struct(
                dedupe_ci(F.filter(images, lambda url: url.isNotNull())).alias("images"),
                clean_text(part).alias("description"),
            )

        return let(content, of_content)

    return let(nodes, of_page)


def lowest_matching(spans_: Column) -> Column:
    """Blocks that hold no other block of the list."""
    return F.filter(spans_, lambda block: ~F.exists(spans_, lambda other: inside(other, block)))
