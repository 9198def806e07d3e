"""Expressions over one page's node array; none of them moves a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.markup import VOID_TAGS
from gleaner.functions.text import blank_to_null, let, normalize_space, split_lines, strip_space

Predicate = Callable[[Column], Column]


def attr(node: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(node["attrs"], F.lit(name)), F.lit(""))


def has_attr(node: Column, name: str) -> Column:
    return F.map_contains_key(node["attrs"], F.lit(name))


def is_element(node: Column) -> Column:
    return ~F.startswith(node["tag"], F.lit("#"))


def has_class(node: Column, *names: str) -> Column:
    escaped = "|".join(name.replace("-", r"\-") for name in names)
    return attr(node, "class").rlike(rf"(?:^|\s)(?:{escaped})(?:\s|$)")


def id_and_class(node: Column) -> Column:
    return F.lower(F.concat(attr(node, "id"), F.lit(" "), attr(node, "class")))


def inside(node: Column, holder: Column) -> Column:
    """Is the node a descendant of the holder?"""
    return (node["node"] > holder["node"]) & (node["node"] <= holder["last"])


def inside_any(node: Column, holders: Column) -> Column:
    return F.exists(holders, lambda holder: inside(node, holder))


def find_all(nodes: Column, wanted: Predicate) -> Column:
    return F.filter(nodes, lambda node: node["live"] & wanted(node))


def find(nodes: Column, wanted: Predicate) -> Column:
    """First live node that fits, NULL when there is none."""
    return F.get(find_all(nodes, wanted), F.lit(0))


def spans(nodes: Column, wanted: Predicate) -> Column:
    """Intervals of the live nodes that fit, ready for ``inside_any``."""
    return F.transform(
        find_all(nodes, wanted), lambda node: F.struct(node["node"].alias("node"), node["last"].alias("last"))
    )


def subtree(nodes: Column, root: Column) -> Column:
    """Descendants of the root; everything when the root is NULL."""
    part = F.slice(nodes, root["node"] + 2, root["last"] - root["node"])
    return F.when(root.isNull(), nodes).otherwise(part)


def descendants(nodes: Column, root: Column) -> Column:
    """Descendants of the root; nothing when the root is NULL."""
    return F.slice(nodes, F.coalesce(root["node"] + 2, F.lit(1)), F.coalesce(root["last"] - root["node"], F.lit(0)))


def remove(nodes: Column, wanted: Predicate) -> Column:
    """Take the fitting nodes off the page, with all below them."""
    return let(nodes, lambda page: let(spans(page, wanted), lambda roots: remove_spans(page, roots)))


def outermost(roots: Column) -> Column:
    """The intervals that lie in no other one, in document order. Intervals of a tree never overlap otherwise."""
    none = F.array().cast("array<struct<node:int,last:int>>")

    def add(held: Column, root: Column) -> Column:
        end = F.try_element_at(held, F.lit(-1))["last"]
        return F.when(F.coalesce(root["last"] <= end, F.lit(False)), held).otherwise(F.concat(held, F.array(root)))

    # By beginning, the longer of equals first; the end that counts is always the last one kept.
    ordered = F.array_sort(F.transform(roots, lambda r: F.struct(r["node"].alias("node"), (-r["last"]).alias("back"))))
    spans_ = F.transform(ordered, lambda r: F.struct(r["node"].cast("int").alias("node"), (-r["back"]).cast("int").alias("last")))
    return F.aggregate(spans_, none, add)


def sweep(nodes: Column, roots: Column, change: Callable[[Column], Column], strict: bool = False) -> Column:
    """The nodes in order, runs of them below the roots passed through ``change`` (an array to an array), each node read once.

    The roots' outermost intervals cut the array into runs, so the work grows with the nodes plus the roots and not with their product.
    ``strict`` leaves an outermost root itself as it is. ``nodes`` is any run of a page's nodes.
    """

    def of_page(page: Column) -> Column:
        base = F.coalesce(F.get(page, F.lit(0))["node"], F.lit(0))

        def cut(edges: Column) -> Column:
            def run(edge: Column, i: Column) -> Column:
                begin = F.coalesce(F.when(i > 0, F.get(edges, i - 1)["last"]), base - 1) + 1
                low = F.greatest(edge["node"] + (1 if strict else 0), base)
                kept = F.slice(page, begin - base + 1, F.greatest(low - begin, F.lit(0)))
                return F.concat(kept, change(F.slice(page, low - base + 1, F.greatest(edge["last"] - low + 1, F.lit(0)))))

            end = F.coalesce(F.try_element_at(edges, F.lit(-1))["last"], base - 1) + 1
            return F.concat(F.flatten(F.transform(edges, run)), F.slice(page, end - base + 1, F.size(page)))

        return let(outermost(roots), cut)

    return let(nodes, of_page)


def remove_spans(nodes: Column, roots: Column) -> Column:
    """Take the roots off the page, with all below them."""
    return sweep(nodes, roots, lambda run: F.transform(run, lambda node: node.withField("live", F.lit(False))))


def outside(nodes: Column, roots: Column) -> Column:
    """The nodes that stand below none of the roots."""
    return sweep(nodes, roots, lambda run: F.slice(run, F.lit(1), F.lit(0)), strict=True)


def keep_span(nodes: Column, root: Column) -> Column:
    """Only the root and what is below it stay on the page."""
    return F.transform(
        nodes,
        lambda node: node.withField(
            "live", node["live"] & (node["node"] >= root["node"]) & (node["node"] <= root["last"])
        ),
    )


def text_pieces(nodes: Column) -> Column:
    texts = F.filter(nodes, lambda node: node["live"] & (node["tag"] == "#text"))
    return F.filter(F.transform(texts, lambda node: strip_space(node["text"])), lambda text: text != "")


def clean_text(nodes: Column) -> Column:
    """Text of the nodes in one line, NULL when there is none."""
    return blank_to_null(normalize_space(F.array_join(text_pieces(nodes), " ")))


def clean_lines(nodes: Column) -> Column:
    """Text of the nodes as non-empty lines."""
    return split_lines(F.array_join(text_pieces(nodes), "\n"))


def _escape(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def render_html(nodes: Column) -> Column:
    """Markup of the live nodes."""
    return let(nodes, _render)


def _render(nodes: Column) -> Column:
    def attributes(node: Column) -> Column:
        entries = F.transform(
            F.map_entries(node["attrs"]),
            lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), F.replace(_escape(e["value"]), F.lit('"'), F.lit("&quot;")), F.lit('"')),
        )
        return F.array_join(entries, "")

    def opening(node: Column) -> Column:
        tag = F.concat(
            F.lit("<"), node["tag"], attributes(node), F.when(node["tag"].isin(*VOID_TAGS), F.lit("/>")).otherwise(">")
        )
        return (
            F.when(node["tag"] == "#text", _escape(node["text"]))
            .when(node["tag"] == "#raw", node["text"])
            .otherwise(tag)
        )

    def closing(node: Column) -> Column:
        ended = F.transform(node["closes"], lambda number: F.get(nodes, number))
        shown = F.filter(ended, lambda e: e["live"] & ~e["tag"].isin(*VOID_TAGS))
        return F.array_join(F.transform(shown, lambda e: F.concat(F.lit("</"), e["tag"], F.lit(">"))), "")

    pieces = F.transform(
        nodes, lambda node: F.concat(F.when(node["live"], opening(node)).otherwise(""), closing(node))
    )
    return F.array_join(pieces, "")
