"""What each of several filters takes away in every order, from counts of the filters that rows fail together."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import settle

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OTHER_SPACES = "\t\n\x0b\x0c\r"
#: The filter of texts that a smaller id has, too.
COPY = "E"
COUNTS = ["rows", "good", "toxic"]


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails by itself: few words, repeated words, capitals, odd signs."""
    words = F.array_remove(F.split(F.translate(text, OTHER_SPACES, " " * len(OTHER_SPACES)), " "), "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def repeated_texts(rows: DataFrame) -> DataFrame:
    """The rows whose whole text a smaller ``doc_id`` has as well: a left semi join on hash, exact text and smaller id.

    ``rows`` holds ``doc_id, text, hash128`` and comes back with all its columns. The other side of the join is reduced first: of
    the rows of one text only the smallest id matters, and only where a larger one exists. Copies meet map-side, so a text that is a
    third of the corpus is one row there. That table is written, so the join has an exchange of its own on both sides, and Spark can
    split a hot left side or send a small right side to all tasks. A null id is neither smaller nor larger than another.
    """
    firsts = rows.groupBy("hash128", "text").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    firsts = settle(firsts.select(F.col("hash128").alias("_hash"), F.col("text").alias("_text"), "low"))
    same = (F.col("hash128") == F.col("_hash")) & (F.col("text") == F.col("_text")) & (F.col("low") < F.col("doc_id"))
    return rows.join(firsts, same, "left_semi")


def failure_sets(docs: DataFrame, failures: Callable[[Column], dict[str, Column]], part_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, part, bits, rows``: rows that agree in id, part and text, how many they are, and the filters they fail.

    Bit i of ``bits`` is the i-th filter, that of copies the last. The rows of the semi join and the rows with failures of their own
    are stacked and summed by row, which is known by id, part and digest of the text. No text is shuffled here.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
    ).withColumn("hash128", F.md5("text"))
    own = failures(F.col("text"))
    bits = reduce(Column.__add__, [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(own.values())])
    keys = ["doc_id", "part", "hash128"]
    every = rows.select(*keys, bits.alias("own"), F.lit(0).alias("copy"), F.lit(1).cast("long").alias("rows"))
    copies = repeated_texts(rows).select(*keys, F.lit(0).alias("own"), F.lit(1 << len(own)).alias("copy"), F.lit(0).cast("long").alias("rows"))
    summed = every.unionByName(copies).groupBy(*keys).agg(F.max("own").alias("own"), F.max("copy").alias("copy"), F.sum("rows").alias("rows"))
    return summed.select("doc_id", "part", (F.col("own") + F.col("copy")).alias("bits"), "rows")


def _orders(letters: list[str]) -> Column:
    """An array with a struct for each step of each order: the filters before it as bits, its own bit, and names."""
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    steps = [
        {"filter_order": "".join(order), "step": i + 1, "before": sum(bit[x] for x in order[:i]), "own": bit[order[i]]}
        for order in permutations(letters)
        for i in range(len(order))
    ]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,own:int>>")


def _total(name: str, keep: Callable[[Column], Column]) -> Column:
    """The sum of a count over those sets of failures that the condition on their bits lets through."""
    return F.aggregate(F.filter("sets", lambda s: keep(s["bits"])), F.lit(0).cast("long"), lambda n, s: n + s[name])


def audit_filters(
    docs: DataFrame, labels: DataFrame, part_col: str = "source", failures: Callable[[Column], dict[str, Column]] = text_failures,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each part, order of the filters and step: what the step's filter does there.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``, zeros included. ``failures``
    gives the conditions of a text's own failures by letter; the filter of copies (``E``) is added. ``labels`` holds
    ``doc_id, quality, toxic``; an id is good or toxic if any of its rows says 1.

    Everything follows from how many rows of a part fail which set of filters, at most 32 counts a part: they are summed map-side, and only
    those counts meet. All orders are then read off the counts inside each part's row, so parts may be many and one may hold most rows.
    In ``shapley`` a row that fails k filters is removed by each of them in 1/k of all orders.

    A null text is empty: it fails for few words only. A null part counts as the empty string. A row with a null id is never a copy, makes
    none and has no labels. Repeated rows count each; equal texts of one id are no copies of each other, as no id is smaller. Null labels
    say nothing. An empty table has no parts and gives no rows. Other columns are not read.
    """
    letters = [*failures(F.lit("")), COPY]
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(name) == 1, F.lit(False)).alias(flag) for name, flag in (("quality", "good"), ("toxic", "toxic"))]
    ).where("doc_id IS NOT NULL AND (good OR toxic)")
    known = known.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    found = failure_sets(docs, failures, part_col, id_col, text_col).join(known, "doc_id", "left")
    sets = found.groupBy("part", "bits").agg(
        F.sum("rows").alias("rows"), *[F.sum(F.when(F.col(flag), F.col("rows")).otherwise(0)).alias(flag) for flag in ("good", "toxic")]
    )
    parts = sets.groupBy("part").agg(F.collect_list(F.struct("bits", *COUNTS)).alias("sets"))
    steps = parts.select("part", "sets", F.inline(_orders(letters)))
    before, own = F.col("before"), F.col("own")
    fails = lambda bits: bits.bitwiseAND(own) != 0
    left = lambda bits: bits.bitwiseAND(before) == 0
    share = F.aggregate(
        F.filter("sets", lambda s: fails(s["bits"])), F.lit(0).cast("long"),
        lambda n, s: n + s["rows"] * (F.lit(factorial(len(letters))) / F.bit_count(s["bits"])).cast("long"),
    )
    return steps.select(
        "part", "filter_order", "step",
        _total("rows", lambda b: left(b) & ~fails(b)).alias("kept"),
        _total("rows", lambda b: left(b) & fails(b)).alias("removed"),
        _total("rows", lambda b: ~left(b) & fails(b)).alias("redundant"),
        _total("rows", lambda b: b == own).alias("unique_fails"),
        _total("good", lambda b: left(b) & fails(b)).alias("good_lost"),
        _total("toxic", lambda b: left(b) & fails(b)).alias("toxic_lost"),
        share.cast("long").alias("shapley"),
    )
