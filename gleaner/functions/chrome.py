"""Finding the blocks of a detail page that are not about the job.

Each removal changes the text its neighbours are measured by, so the page is walked in order.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns on attributes and texts of blocks that are removed.
_ACTION = (
    r"(?:apply(?:\s+now|\s+online|\s+for\s+this\s+job|\s+to\s+this\s+job)?|refer\s+to\s+a\s+friend)\W*"
)
ACTION_TEXT = re.compile(rf"^\s*{_ACTION}$", re.I)
ACTION_ONLY = re.compile(rf"\s*{_ACTION}(?:\s+{_ACTION})*\s*", re.I | re.S)
RELATED_HEADING = re.compile(
    r"^\s*(?:similar|related|recommended)\s+jobs?\b|^\s*jobs\s+you\s+may\s+like\b|^\s*more\s+jobs\s+like\s+this\b", re.I
)
ALL_JOBS_HEADING = re.compile(r"^\s*(?:all\s+jobs|view\s+all\s+jobs|see\s+all\s+jobs|back\s+to\s+(?:all\s+)?jobs)\s*$", re.I)
RELATED_ATTRS = re.compile(
    r"(?:similar|related|recommended)[\s_-]*jobs?|jobs[\s_-]*you[\s_-]*may[\s_-]*like|all[\s_-]*jobs", re.I
)
RELATED_BLOCK_ATTRS = re.compile(r"(?:similar|related|recommended)[\s_-]*jobs?|all[\s_-]*jobs", re.I)
COOKIE_ATTRS = re.compile("cookie", re.I)
APPLY_ATTRS = re.compile(
    r"(?:^|[\s_-])(?:social[\s_-]*apply|dialogapplybtn|applyoption|applylistitemoption|"
    r"apply[\s_-]*(?:button|btn|container|link|option)|btn[\s_-]*social[\s_-]*apply)(?:$|[\s_-])|"
    r"/talentcommunity/apply/|start\s+applying|start\s+the\s+apply\s+process|"
    r"enter\s+email\s+to\s+start\s+application\s+process",
    re.I,
)
APPLY_BLOCK_ATTRS = re.compile(
    r"social[\s_-]*apply[\s_-]*button[\s_-]*container|btn[\s_-]*social[\s_-]*apply|"
    r"socialbutton|emailgetter|applylistitemoption|applyoption|dialogapplybtn",
    re.I,
)
JOB_BODY = re.compile(
    r"\b(?:job\s+description|responsibilities|qualifications|requirements|required\s+experience|"
    r"skills|benefits|about\s+the\s+role|purpose\s+of\s+the\s+role)\b",
    re.I,
)
HIDDEN_STYLE = re.compile(
    r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0+)?(?:\s*;|$)|"
    r"(?:^|;)\s*(?:width|height)\s*:\s*0(?:px|em|rem|%)?"
)
VENDOR_IDS = {"asbranding", "asbreadcrumbs"}
NAMING_ATTRS = ("id", "class", "aria-label", "title", "data-testid", "data-automation", "data-test")
ALL_ATTRS = ("id", "class", "href", "aria-label", "title", "data-testid", "data-automation", "data-test", "data-ht", "placeholder", "action")
CONTENT_TAGS = {"h1", "h2", "h3", "h4", "p", "ul", "ol", "table", "article"}
HEADING_CHARS = 1000
APPLY_TEXT_LIMIT, RELATED_TEXT_LIMIT, BODY_TEXT_LIMIT, ACTION_TEXT_LIMIT = 1200, 1500, 800, 250


class _Page:
    """The nodes of one page, with the removals made so far."""

    def __init__(self, nodes: list[dict]) -> None:
        self.nodes = nodes
        self.gone = [not node["live"] for node in nodes]
        self.roots: list[dict] = []
        self.attrs = [dict(node["attrs"] or ()) for node in nodes]
        self.pieces = {i: piece for i, node in enumerate(nodes) if node["tag"] == "#text" and (piece := node["text"].strip())}
        self.places = list(self.pieces)

    def elements(self):
        for number, node in enumerate(self.nodes):
            if node["tag"][0] != "#" and not self.gone[number]:
                yield number

    def words(self, number: int, names: tuple[str, ...]) -> str:
        attrs = self.attrs[number]
        return " ".join(attrs[name] for name in names if attrs.get(name))

    def text(self, number: int, enough: int | None = None) -> str:
        """The text below a node; of a longer one, only its beginning of at least ``enough`` characters."""
        last, found, size = self.nodes[number]["last"], [], 0
        for k in range(bisect_left(self.places, number), len(self.places)):
            place = self.places[k]
            if place > last or (enough is not None and size > enough):
                break
            if not self.gone[place]:
                found.append(self.pieces[place])
                size += len(found[-1]) + 1
        return " ".join(found)

    def opens_with(self, number: int, *patterns: re.Pattern) -> bool:
        """Whether the node's text matches a pattern; the whole of a long text is read only if its beginning does."""
        text = self.text(number, HEADING_CHARS)
        matched = [p for p in patterns if p.match(text)]
        return bool(matched) and (len(text) <= HEADING_CHARS or any(p.match(self.text(number)) for p in matched))

    def holds(self, number: int, tags: set[str]) -> bool:
        run = range(number + 1, self.nodes[number]["last"] + 1)
        return any(self.nodes[i]["tag"] in tags and not self.gone[i] for i in run)

    def ancestors(self, number: int, stops: tuple[str, ...]):
        parent = self.nodes[number]["parent"]
        while parent >= 0 and not self.gone[parent] and self.nodes[parent]["tag"] not in stops:
            yield parent, self.nodes[parent]["tag"]
            parent = self.nodes[parent]["parent"]

    def remove(self, number: int) -> None:
        last = self.nodes[number]["last"]
        self.roots.append({"node": number, "last": last})
        for i in range(number, last + 1):
            self.gone[i] = True


def _apply_block(page: _Page, number: int) -> int:
    block = number
    for parent, tag in page.ancestors(number, ("body", "main", "article")):
        wrapper = APPLY_BLOCK_ATTRS.search(page.words(parent, NAMING_ATTRS))
        small = tag in ("div", "section", "aside", "form", "ul", "li") and len(page.text(parent, APPLY_TEXT_LIMIT)) <= APPLY_TEXT_LIMIT
        if not (wrapper or small):
            break
        block = parent
    return block


def _related_block(page: _Page, number: int) -> int:
    block = number
    for parent, tag in page.ancestors(number, ("body", "main", "article")):
        text = page.text(parent, RELATED_TEXT_LIMIT)
        if len(text) > BODY_TEXT_LIMIT and JOB_BODY.search(page.text(parent)):
            break
        if tag in ("section", "aside", "nav") or RELATED_BLOCK_ATTRS.search(page.words(parent, NAMING_ATTRS)):
            return parent
        if tag not in ("div", "ul", "ol", "li") or len(text) > RELATED_TEXT_LIMIT:
            break
        block = parent
    return block


def _action_block(page: _Page, number: int) -> int:
    block = number
    for parent, tag in page.ancestors(number, ("body", "main")):
        if tag not in ("div", "section", "aside", "form", "p", "li"):
            continue
        text = page.text(parent, ACTION_TEXT_LIMIT)
        if len(text) > ACTION_TEXT_LIMIT or page.holds(parent, CONTENT_TAGS) or not ACTION_ONLY.fullmatch(text):
            break
        block = parent
    return block


def _is_action(page: _Page, number: int) -> bool:
    tag, attrs = page.nodes[number]["tag"], page.attrs[number]
    if tag == "input":
        return bool(ACTION_TEXT.match(attrs.get("value", "")))
    if tag not in ("a", "button") and attrs.get("role") != "button":
        return False
    labels = " ".join(attrs.get(name, "") for name in ("aria-label", "title", "value"))
    return bool(page.opens_with(number, ACTION_TEXT) or ACTION_TEXT.match(labels.strip()))


def mark_chrome(nodes: list[dict]) -> list[dict]:
    """Intervals to take off one page."""
    page = _Page(nodes)
    for number in page.elements():
        words = page.words(number, ALL_ATTRS)
        attrs = page.attrs[number]
        if (
            attrs.get("id", "").strip().lower() in VENDOR_IDS
            or COOKIE_ATTRS.search(words)
            or HIDDEN_STYLE.search(attrs.get("style", "").lower())
        ):
            page.remove(number)
        elif APPLY_ATTRS.search(words):
            page.remove(_apply_block(page, number))
        elif RELATED_ATTRS.search(words):
            page.remove(_related_block(page, number))
    for number in page.elements():
        if _is_action(page, number):
            page.remove(_action_block(page, number))
    for number in page.elements():
        if page.opens_with(number, RELATED_HEADING, ALL_JOBS_HEADING):
            page.remove(_related_block(page, number))
    return page.roots


_ROOTS = pa.list_(pa.struct([("node", pa.int32()), ("last", pa.int32())]))


def chrome_roots(nodes: Column) -> Column:
    """Intervals of the page chrome in a node array."""

    @F.arrow_udf("array<struct<node:int,last:int>>")
    def find_chrome(pages: pa.Array) -> pa.Array:
        # One page at a time becomes Python objects.
        found = (None if not page.is_valid else mark_chrome(page.as_py()) for page in pages)
        return pa.array(found, type=_ROOTS)

    # Only what the walk reads crosses to Python.
    slim = F.transform(
        nodes,
        lambda n: F.struct(*[n[name].alias(name) for name in ("node", "last", "parent", "tag", "attrs", "text", "live")]),
    )
    return find_chrome(slim)
