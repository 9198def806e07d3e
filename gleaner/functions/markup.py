"""Html text to an array of nodes. The only place where markup is parsed.

Nodes stand in document order, so ``node`` is also the position in the array and the subtree of a
node is the run ``node .. last``. Text pieces are nodes tagged ``#text``; what stands anywhere below
script, style, template or ruby annotations is ``#raw`` and never counts as page text.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

NODE = (
    "struct<node:int,last:int,parent:int,depth:int,tag:string,attrs:map<string,string>,text:string,"
    "href:string,src:string,closes:array<int>,live:boolean>"
)
NODES = f"array<{NODE}>"
_ARROW_NODES = pa.list_(
    pa.struct(
        [
            ("node", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()),
            ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
            ("href", pa.string()), ("src", pa.string()), ("closes", pa.list_(pa.int32())), ("live", pa.bool_()),
        ]
    )
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW_CONTAINERS = frozenset(("script", "style", "template", "rt", "rp"))


class _NodeReader(HTMLParser):
    """Builds the node list: a close tag pops to its match, an unmatched one is ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.stack: list[int] = []
        self.open_tags: dict[str, int] = {}
        self.raw_depth = 0
        self.pieces: list[str] = []

    def _add(self, tag: str, attrs: list, text: str | None) -> int:
        number = len(self.nodes)
        self.nodes.append(
            {
                "node": number, "last": number, "parent": self.stack[-1] if self.stack else -1,
                "depth": len(self.stack), "tag": tag, "attrs": attrs, "text": text,
                "href": None, "src": None, "closes": [], "live": True,
            }
        )
        return number

    def _flush(self) -> None:
        text = "".join(self.pieces)
        self.pieces.clear()
        if not text:
            return
        if not text.strip(" \t\n\r\f"):
            text = "\n" if "\n" in text else " "
        number = self._add("#raw" if self.raw_depth else "#text", [], text)
        self.nodes[number]["closes"] = []

    def _close(self, number: int) -> None:
        last = len(self.nodes) - 1
        self.nodes[number]["last"] = last
        self.nodes[last]["closes"].append(number)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        number = self._add(tag, list({name: value or "" for name, value in attrs}.items()), None)
        if tag in VOID_TAGS:
            self._close(number)
        else:
            self.stack.append(number)
            self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
            self.raw_depth += tag in _RAW_CONTAINERS

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        while self.open_tags.get(tag):
            number = self.stack.pop()
            name = self.nodes[number]["tag"]
            self.open_tags[name] -= 1
            self.raw_depth -= name in _RAW_CONTAINERS
            self._close(number)
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    def handle_decl(self, decl: str) -> None:
        self._flush()

    def unknown_decl(self, data: str) -> None:
        self._flush()
        if data.upper().startswith("CDATA["):
            self.pieces.append(data[len("CDATA[") :])
            self._flush()

    def finish(self) -> list[dict]:
        self.close()
        self._flush()
        while self.stack:
            self._close(self.stack.pop())
        return self.nodes


def _resolve(base: str, ref: str | None) -> str | None:
    try:
        return urljoin(base, ref) if ref else None
    except ValueError:
        return None


def read_nodes(html: str | None, url: str | None, use_base: bool) -> list[dict]:
    """Nodes of one page; links resolved against the page or, if asked, its base tag."""
    reader = _NodeReader()
    try:
        reader.feed(html or "")
        nodes = reader.finish()
    except AssertionError:
        # The parser gives up on unknown marked sections; browsers take them for comments up to the next mark, and so does it with a space.
        reader = _NodeReader()
        reader.feed(html.replace("<![", "<! ["))
        nodes = reader.finish()
    base = url or ""
    if use_base:
        hints = (dict(n["attrs"]).get("href", "").strip() for n in nodes if n["tag"] == "base")
        base = _resolve(base, next((hint for hint in hints if hint), None)) or base
    for node in nodes:
        for name, value in node["attrs"]:
            if name in ("href", "src"):
                node[name] = _resolve(base, value.strip() if use_base else value)
    return nodes


# Letters of pages turned into nodes at a time; one that is longer goes alone. The rest of a batch waits as plain Arrow text.
_LETTERS_AT_ONCE = 200_000


def _runs(htmls: pa.Array) -> Iterator[tuple[int, int]]:
    """The batch cut into runs of pages, as start and length."""
    start = letters = 0
    for i, size in enumerate(pc.binary_length(htmls).to_pylist()):
        if i > start and letters + (size or 0) > _LETTERS_AT_ONCE:
            yield start, i - start
            start, letters = i, 0
        letters += (size or 0) + 100
    if len(htmls) > start:
        yield start, len(htmls) - start


def node_runs(batches: Iterator[tuple[pa.Array, pa.Array]], use_base: bool) -> Iterator[pa.Array]:
    """The node arrays of batches of pages and addresses. Nodes are many times the size of their page, so they come run by run, not batch by batch."""
    for htmls, urls in batches:
        for start, length in _runs(htmls):
            pages = zip(htmls.slice(start, length).to_pylist(), urls.slice(start, length).to_pylist())
            yield pa.array([read_nodes(page, address, use_base) for page, address in pages], type=_ARROW_NODES)


def parse_nodes(html: Column, url: Column, use_base: bool = False) -> Column:
    """Array of nodes of a page."""

    @F.arrow_udf(NODES)
    def parse(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return node_runs(batches, use_base)

    return parse(html, url)
