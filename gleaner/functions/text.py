"""Text, JSON-text, number and date expressions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import constants as K

# Java's \s under (?U) covers nbsp and friends, but not the four separators.
SPACE = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_map(table: dict[str, str | tuple]) -> Column:
    """Constant map; tuples become arrays. One expression text instead of a column per entry."""

    def text(value: str | tuple) -> str:
        if isinstance(value, tuple):
            return f"array({', '.join(text(item) for item in value)})"
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return F.expr(f"map({', '.join(text(item) for pair in table.items() for item in pair)})")


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def strip_space(value: Column) -> Column:
    """Cut white space, Unicode included, from both ends."""
    return F.regexp_replace(value, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def normalize_space(value: Column) -> Column:
    """One blank for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(value, rf"(?U){SPACE}+", " "))


def split_lines(value: Column) -> Column:
    """Non-empty lines, blanks within a line collapsed."""

    def tidy(line: Column) -> Column:
        return strip_space(F.regexp_replace(F.replace(line, F.lit("\u00a0"), F.lit(" ")), r"[ \t\r\f\x0b]+", " "))

    return F.filter(F.transform(F.split(value, LINE_BREAK), tidy), lambda line: line != "")


def truncate_text(value: Column, limit: int, suffix: str = "...") -> Column:
    return F.when(F.length(value) > limit, F.concat(F.left(value, F.lit(limit)), F.lit(suffix))).otherwise(value)


def display_text(value: Column, limit: int = K.DISPLAY_LIMIT) -> Column:
    return F.coalesce(truncate_text(blank_to_null(value), limit), F.lit("N/A"))


def strip_code_fence(value: Column, any_fence: bool = True) -> Column:
    """Take off a Markdown fence; ``any_fence=False`` knows only the json-tagged opening."""
    text = strip_space(F.coalesce(value, F.lit("")))
    opening = "^```(?:json)?" if any_fence else "^```json"
    text = F.regexp_replace(F.regexp_replace(text, opening, ""), r"```\z", "")
    return strip_space(text) if any_fence else text


def collapse_blank_lines(value: Column) -> Column:
    """Tidy each line and keep at most one empty line in a row."""
    text = F.regexp_replace(value, LINE_BREAK, "\n")
    text = F.replace(text, F.lit("\u00a0"), F.lit(" "))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    return strip_space(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def first_int(value: Column) -> Column:
    digits = F.regexp_extract(F.coalesce(value, F.lit("")), r"(?U)\d+", 0)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def deadline_or_default(value: Column, run_ts: datetime, days: int = K.DEADLINE_DAYS) -> Column:
    """The time the text spells in a known layout, else the run time plus some days.

    The layout is picked by shape first: a failed parse costs far more than a pattern.
    """
    text = strip_space(value)
    parsed = None
    for shape, layout in K.DEADLINE_LAYOUTS.items():
        moment = F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz")
        parsed = F.when(text.rlike(shape), moment) if parsed is None else parsed.when(text.rlike(shape), moment)
    fallback = F.lit(run_ts.isoformat(sep=" ")).cast("timestamp_ntz") + F.make_interval(days=F.lit(days))
    return F.coalesce(parsed, fallback)


def fix_mojibake(value: Column) -> Column:
    """Drop the stray A-circumflex left by double encoding."""
    text = F.replace(value, F.lit("\u00c2\u00a0"), F.lit("\u00a0"))
    text = F.replace(text, F.lit("\u00c2 "), F.lit(" "))
    return F.regexp_replace(text, rf"(?U)\u00c2(?={SPACE}|<|&)", "")


def drop_blank_fields(fields: Column) -> Column:
    """Keep the map entries that hold some text."""
    return F.map_filter(fields, lambda _, value: value.isNotNull() & (strip_space(value) != ""))


def dedupe_ci(values: Column) -> Column:
    """Case-insensitive distinct of an array; the first spelling stays, in order."""

    # Sorted by key and place, so equal keys stand side by side and the first spelling leads them.
    marked = F.transform(values, lambda value, i: F.struct(F.lower(value).alias("key"), i.alias("at"), value.alias("spelling")))

    def leading(rows: Column) -> Column:
        first = F.filter(rows, lambda row, i: (i == 0) | ~row["key"].eqNullSafe(F.get(rows, i - 1)["key"]))
        ordered = F.array_sort(F.transform(first, lambda row: F.struct(row["at"].alias("at"), row["spelling"].alias("spelling"))))
        return F.transform(ordered, lambda row: row["spelling"])

    return let(F.array_sort(marked), leading)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.coalesce(value, F.lit(high)), F.lit(high)))
