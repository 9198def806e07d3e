"""The main text of a page by the distribution of its text over lines."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import prepare

#: Lines that a window holds, and the part of the fullest window that a stretch must reach where no element names the article.
WINDOW, SURGE = 3, 0.2

_words = lambda names: frozenset(names.split())
# What stands in these is no text of the page.
_SILENT = _words("script style template noscript title iframe object svg canvas math audio video map select option datalist button label textarea")
_RAW = _words("script style title textarea iframe noscript")
_FURNITURE = _words("nav footer aside form menu dialog fieldset search")
_HEADINGS = _words("h1 h2 h3 h4 h5 h6")
_BLOCKS = _words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul"
)
_VOID = _words("area base br col embed hr img input link meta param source track wbr")
_MAIN = _words("article main")
# An opening tag of the first kind ends an open one of the second, where that is the innermost.
_ENDS = {
    **{tag: _words("p") for tag in _BLOCKS}, "li": _words("p li"), "dt": _words("p dt dd"), "dd": _words("p dt dd"), "td": _words("p td th"), "th": _words("p td th"),
    "tr": _words("p td th tr"), "tbody": _words("p td th tr thead tbody"), "tfoot": _words("p td th tr tbody"), "option": _words("option"),
}
# Words of class, id and role that name furniture.
_NAMED = _words(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments reply replies respond disqus share sharing social "
    "newsletter subscribe signup login related recommended pagination pager skip contentinfo complementary search searchbar"
)
_PART_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TAG = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_NAMES = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class _Page:
    """The lines of a page: text, number of the innermost box, letters that count. Boxes are open furniture or main elements."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, int]] = []
        self.boxes: list[list] = [[-1, ""]]  # each: the box around it, and "main", "out", "layout" or ""
        self.box = 0
        self.open: list[tuple[str, int]] = []  # elements, each with the box around it
        self.counts: dict[str, int] = {}
        self.pieces: list[str] = []
        self.linked = 0
        self.link: int | None = None  # elements that were open where the open link began
        self.silent = 0

    def text(self, raw: str) -> None:
        if raw and not self.silent:
            piece = unescape(raw) if "&" in raw else raw
            self.pieces.append(piece)
            # A linked heading is a heading.
            if self.link is not None and not (self.open and self.open[-1][0] in _HEADINGS):
                self.linked += len("".join(piece.split()))

    def end_line(self) -> None:
        words = "".join(self.pieces).split()
        if words:
            line = " ".join(words)
            self.lines.append((line, self.box, sum(map(len, words)) - self.linked))
        self.pieces, self.linked = [], 0

    def _pop(self) -> None:
        tag, self.box = self.open.pop()
        self.counts[tag] -= 1
        self.silent -= tag in _SILENT
        if self.link is not None and len(self.open) < self.link:
            self.link = None

    def start(self, tag: str, names: str) -> None:
        if tag == "a":
            self.link = len(self.open)
            return
        if tag in _BLOCKS:
            self.end_line()
        elif tag == "br":
            self.text(" ")
        if tag in _VOID:
            return
        # Elements that only mark letters are no boxes and need no end.
        if tag not in _BLOCKS and tag not in _SILENT and tag != "span":
            return
        ends = _ENDS.get(tag, ())
        while self.open and self.open[-1][0] in ends:
            self._pop()
        self.open.append((tag, self.box))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.silent += tag in _SILENT
        if tag == "h1":
            self._keep_layout()
        kind = self._kind(tag, names)
        if kind:
            self.boxes.append([self.box, kind])
            self.box = len(self.boxes) - 1

    def _kind(self, tag: str, names: str) -> str:
        found = _NAMES.findall(names) if names else ()
        said = {word.lower() for _, *values in found for value in values for word in _PART_WORD.findall(value)}
        if tag in _MAIN or any(name.lower() == "role" and "main" in values for name, *values in found):
            # Readers' comments are often articles, too.
            return "out" if said & {"comment", "comments", "reply", "replies"} else "main"
        if tag == "header":
            return "" if self._inside_main() else "out"
        if tag in ("html", "body", "h1"):
            return ""
        if tag in _FURNITURE:
            return "layout" if tag == "form" else "out"
        if "header" in said and not self._inside_main():
            return "out" if "site" in said else "layout"
        return "layout" if said & _NAMED else ""

    def _inside_main(self) -> bool:
        box = self.box
        while box > 0 and self.boxes[box][1] != "main":
            box = self.boxes[box][0]
        return box > 0

    def _keep_layout(self) -> None:
        """A form or named box around the headline is the page's layout, not furniture."""
        box = self.box
        while box > 0 and self.boxes[box][1] == "layout":
            self.boxes[box][1] = ""
            box = self.boxes[box][0]

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = None
        elif tag == "p" and not self.counts.get(tag):
            self.end_line()
        elif self.counts.get(tag):
            if tag in _BLOCKS:
                self.end_line()
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()

    def weights(self) -> tuple[np.ndarray, list[bool], bool]:
        """Letters of each line that count, which lines are furniture, and whether an element names the main text.

        Lines in furniture count nothing. If there are main elements, lines outside of them count nothing, and those inside in full;
        else letters in links do not count.
        """
        inside, out = [False], [False]
        for around, kind in self.boxes[1:]:
            main = kind == "main"
            inside.append(inside[around] or main)
            out.append(kind in ("out", "layout") or (out[around] and not (main and not inside[around])))
        named = any(kind == "main" and not out[i] for i, (_, kind) in enumerate(self.boxes))
        full = lambda line: len(line) - line.count(" ")
        found = [0 if out[box] or (named and not inside[box]) else full(line) if named else count for line, box, count in self.lines]
        return np.array(found, dtype=np.int64), [out[box] for _, box, _ in self.lines], named


def _read(html: str) -> _Page:
    page, at, size = _Page(), 0, len(html)
    last_close = html.rfind(">")
    missing = {'"': size + 1, "'": size + 1}  # from here on no such quote follows
    endless: set[str] = set()  # elements of raw text that have no end in what is left
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            page.text(html[at:])
            break
        page.text(html[at:lt])
        tag = _TAG.match(html, lt + 1)
        if not tag:
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            elif html.startswith(("<!", "<?", "</"), lt):
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                page.text("<")
                at = lt + 1
            continue
        if lt > last_close:
            break  # cut off inside a tag
        name, here = tag[2].lower(), tag.end()
        while True:
            here = _PLAIN.match(html, here).end()
            if here >= size or html[here] == ">":
                break
            quote = html[here]
            before = here - 1
            while html[before].isspace():
                before -= 1
            if html[before] != "=":
                here += 1  # no value begins here
                continue
            close = -1 if here >= missing[quote] else html.find(quote, here + 1)
            if close < 0:
                missing[quote] = min(missing[quote], here)
                here = html.find(">", here)
                here = size if here < 0 else here
                break
            here = close + 1
        attrs, at = html[tag.end() : here], here + 1
        if tag[1]:
            page.end(name)
            continue
        page.start(name, attrs)
        if name in _RAW and name not in endless:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            if close:
                at = close.start()
            elif name in ("script", "style"):
                break
            else:
                endless.add(name)
    page.end_line()
    return page


def _stretches(weights: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """From each surge to the next dive: first and last line that count, and the fullest window between them."""
    if not weights.any():
        return []
    sums = np.convolve(weights, np.ones(window, dtype=np.int64))[window - 1 :]  # of the lines i .. i + window - 1
    full = sums > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], full, [False])).astype(np.int8)))
    found = []
    for surge, dive in zip(edges[::2], edges[1::2]):
        lines = surge + np.flatnonzero(weights[surge : dive + window - 1])
        found.append((int(lines[0]), int(lines[-1]), int(sums[surge:dive].max())))
    return found


def main_text(html: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    """The main text of one page; see ``extract_main_text``."""
    page = _read(html or "")
    weights, furniture, named = page.weights()
    stretches = _stretches(weights, window)
    least = 0 if named else surge * max((peak for *_, peak in stretches), default=0)
    kept = [i for low, high, peak in stretches if peak >= least for i in range(low, high + 1)]
    return " ".join(page.lines[i][0] for i in kept if weights[i] or not (named or furniture[i]))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, surge: float = SURGE) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Markup is stripped to lines, one for each block, with character references decoded and white space as one space. The letters of
    each line are summed over sliding windows of ``window`` lines; a stretch begins where the sum surges from nothing and ends
    where it dives to nothing again. Lines in furniture (menus, headers, footers, sidebars, notices, adverts, forms, readers'
    comments, by element or by words of class, id and role) are part of the distribution but weigh nothing, and so part stretches. If a
    page names its article (``article``, ``main``, ``role=main``), other lines weigh nothing, too, and every stretch is
    main text, however short. If not, letters in links weigh nothing, and the stretches count whose fullest window holds at least
    ``surge`` of the page's fullest one; lines of links between their lines stay.

    A null html counts as empty. Pages without text, without main text or of furniture alone give the empty string; html without any tag is
    one line. Unclosed, wrongly nested and cut off tags are read as browsers do: what is open ends with what holds it. Repeated rows and
    null ids and urls give a row each. An empty table gives no rows; other columns are not read. Pages are rows and work is narrow:
    nothing is shuffled, time grows with the length of a page.
    """
    prepare(pages.sparkSession)

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        return pa.array((main_text(html.as_py(), window, surge) for html in column), type=pa.string())

    found = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), texts(F.col(html_col).cast("string")).alias("text")
    )
    return found.withColumn("n_chars", F.length("text").cast("long"))
