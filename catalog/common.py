"""Shared bindings of the queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.urls import url_host
from gleaner.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
KEY_SQL = "regexp_replace(url, '[?#].*$', '')"
# White space as Python and Spark's (?U) see it, spelled for RE2.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def strip_sql(value: str) -> str:
    return rf"regexp_replace({value}, '^{WS}+|{WS}+$', '', 'g')"


def normalize_sql(value: str) -> str:
    return rf"trim(regexp_replace({value}, '{WS}+', ' ', 'g'))"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def pick(values: list[str], index):
    """The value at ``index`` modulo the list length."""
    items = F.array(*[F.lit(v) for v in values])
    return F.get(items, F.pmod(index, F.lit(len(values))).cast("int"))


def pick_sql(values: list[str], index: str) -> str:
    return f"{sql_list(values)}[(({index}) % {len(values)}) + 1]"


def pages(spark: SparkSession, folder: str, spread: bool = True) -> DataFrame:
    return read_table(spark, folder, "pages", spread)


def pages_with_host(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).withColumn("host", url_host(F.col("url")))
