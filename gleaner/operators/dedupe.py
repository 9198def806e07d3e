"""Distinct, first-per-key, set operators and anti joins on URL keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import blank_to_null, strip_space
from gleaner.functions.urls import url_key
from gleaner.operators.ranking import top_n
from gleaner.operators.shape import present


def known_urls(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """Distinct stored URLs; an empty first spelling hides the later ones, then drops out."""
    names = present(df, columns)
    source = F.coalesce(*[F.col(name) for name in names]) if names else F.lit(None).cast("string")
    urls = df.select(source.alias("source_url")).filter(F.col("source_url") != "").distinct()
    return urls.limit(limit) if limit else urls


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def first_per_key(df: DataFrame, key: str | list[str], order) -> DataFrame:
    """The first row of every key."""
    return top_n(df, key, order, 1)


def drop_landing(links: DataFrame, landing_url: str | Column, key: str = "url_key") -> DataFrame:
    """Drop links that lead back to the listing itself."""
    landing = F.lit(landing_url) if isinstance(landing_url, str) else landing_url
    return links.filter(F.col(key) != url_key(landing))


def ordered_distinct(df: DataFrame, value: str | list[str], order: str) -> DataFrame:
    """Each value once, with the position where it first stood."""
    keys = [value] if isinstance(value, str) else list(value)
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def dedupe_composite(df: DataFrame, columns: list[str], order) -> DataFrame:
    """First row per combination of columns, NULLs alike."""
    return top_n(df, columns, order, 1)


def record_identity(columns: list[str]) -> Column:
    """Canonical JSON of the filled fields, named in sorted order; '{}' when nothing is filled."""
    fields = [blank_to_null(strip_space(F.col(name).cast("string"))).alias(name) for name in sorted(columns)]
    return F.to_json(F.struct(*fields))


def dedupe_record(df: DataFrame, columns: list[str], order, within: list[str] | None = None) -> DataFrame:
    """First of every set of equal records; records without content are dropped."""
    marked = df.withColumn("_identity", record_identity(columns)).filter(F.col("_identity") != "{}")
    keyed = marked.withColumn("_identity", F.sha2("_identity", 256))
    return top_n(keyed, [*(within or []), "_identity"], order, 1).drop("_identity")


def union_links(sources: list[DataFrame], listing: str = "listing_id", position: str = "pos") -> DataFrame:
    """Links of several finders in finder order, each URL once per listing."""
    stacked = None
    for rank, source in enumerate(sources):
        part = source.select(listing, "url", F.struct(F.lit(rank).alias("source"), F.col(position).alias("pos")).alias("place"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return ordered_distinct(stacked, [listing, "url"], "place")


def union_if_empty(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """The primary rows, plus the fallback rows of keys that have no primary row."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"))


def known_after_run(known: DataFrame, saved: DataFrame, column: str = "source_url") -> DataFrame:
    return known.select(column).union(saved.select(column)).distinct()


def anti_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is not among ``keys`` (first column). Rows without a key stay.

    No key can match them, so each gets a number in its place: they are dealt out evenly and do not meet in one task.
    """
    known = keys.select(F.col(keys.columns[0]).alias("_known")).filter("_known <> ''").distinct()
    none = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    probed = df.withColumn("_probe", F.when(F.col(column) != "", F.col(column)).otherwise(none))
    return probed.join(known, F.col("_probe") == F.col("_known"), "left_anti").drop("_probe")


def anti_known(
    df: DataFrame, known: DataFrame, url: str = "url", known_url: str = "source_url", key: str | None = None
) -> DataFrame:
    """Rows whose page identity is not stored yet; ``key`` names a column that holds the identity already."""
    keys = known.select(url_key(F.col(known_url)).alias("key"))
    if key:
        return anti_keys(df, keys, key)
    return anti_keys(df.withColumn("_key", url_key(F.col(url))), keys, "_key").drop("_key")


def anti_known_raw(df: DataFrame, known: DataFrame, url: str = "url", known_url: str = "source_url") -> DataFrame:
    """Rows whose exact URL is not stored yet; rows without URL are dropped."""
    stored = known.select(F.col(known_url).alias("_stored")).distinct()
    return df.filter(F.col(url) != "").join(stored, F.col(url) == F.col("_stored"), "left_anti")
