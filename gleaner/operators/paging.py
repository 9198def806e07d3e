"""A page of a sorted table by order statistics: ranges of keys are counted, and only the range that holds the page is sorted."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are sorted as they are; larger tables are cut into ranges first.
SORTED_ROWS = 100_000
#: Ranges that a pass counts, and rows whose keys it looks at to cut them.
RANGES, SAMPLE_ROWS = 32, 4_000


def _is_after(values: list[Column], bound: list[Any], descending: list[bool]) -> Column:
    """Whether a row stands behind a bound; nulls stand first in ascending order and last in descending."""
    after, same = F.lit(False), F.lit(True)
    for value, at, down in zip(values, bound, descending):
        if at is None:
            beyond, equal = (F.lit(False) if down else value.isNotNull()), value.isNull()
        else:
            beyond = F.coalesce(value < F.lit(at), F.lit(True)) if down else F.coalesce(value > F.lit(at), F.lit(False))
            equal = F.coalesce(value == F.lit(at), F.lit(False))
        after, same = after | (same & beyond), same & equal
    return after


def narrowed(df: DataFrame, order: list[tuple[Column, bool]], first: int, last: int, total: int) -> tuple[DataFrame, int]:
    """The rows of a range of keys that holds the ``first`` to ``last`` row (from 0) of the order, and how many rows stand before that range.

    ``order``: columns and whether they descend. Each pass cuts the rows that are left into ranges at keys of a small sample, counts them
    (map-side, at most ``RANGES`` numbers a task), and keeps the ranges that hold the page. The counts are exact, the sample only places the cuts.
    It ends when few rows are left, or when rows that agree in all of the order fill the range.
    """
    values, descending = [value for value, _ in order], [down for _, down in order]
    names = [f"_o{i}" for i in range(len(order))]
    left, before = total, 0
    while left > SORTED_ROWS:
        keys = df.select(*[value.alias(name) for value, name in zip(values, names)])
        seen = keys.sample(min(1.0, SAMPLE_ROWS / left), seed=1).limit(2 * SAMPLE_ROWS)
        ordered = seen.orderBy(*[F.desc(n) if down else F.asc(n) for n, down in zip(names, descending)]).collect()
        bounds = list(dict.fromkeys(tuple(ordered[len(ordered) * i // RANGES]) for i in range(1, RANGES))) if ordered else []
        columns = [F.col(name) for name in names]
        place = reduce(Column.__add__, [_is_after(columns, list(bound), descending).cast("int") for bound in bounds], F.lit(0))
        sizes = dict(keys.groupBy(place.alias("range")).agg(F.count(F.lit(1)).alias("n")).collect())
        low, passed = 0, before
        while passed + sizes.get(low, 0) <= first and low < len(bounds):
            passed += sizes.get(low, 0)
            low += 1
        high, reached = low, passed + sizes.get(low, 0)
        while reached <= last and high < len(bounds):
            high += 1
            reached += sizes.get(high, 0)
        if reached - passed >= left:
            break
        if low:
            df = df.filter(_is_after(values, list(bounds[low - 1]), descending))
        if high < len(bounds):
            df = df.filter(~_is_after(values, list(bounds[high]), descending))
        left, before = reached - passed, passed
    return df, before
