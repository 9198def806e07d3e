"""Feeds, caps, run choice and run counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.geo import is_canada_us
from gleaner.functions.text import strip_space
from gleaner.operators.dedupe import ordered_distinct
from gleaner.operators.ranking import top_n

FEED_CONFIG = "struct<feeds:array<struct<url:string,fields:struct<location:boolean>>>>"


def explode_feeds(configs: DataFrame) -> DataFrame:
    """One row per usable feed of the config rows, in config and feed order."""
    parsed = configs.filter(F.col("micrositeId") != "").select(
        F.col("id").alias("config_id"),
        F.col("micrositeId").alias("site_id"),
        F.posexplode_outer(F.from_json("config", FEED_CONFIG)["feeds"]).alias("feed_pos", "feed"),
    )
    return parsed.filter(F.col("feed.url") != "").select(
        "config_id",
        "site_id",
        "feed_pos",
        F.col("feed.url").alias("feed_url"),
        F.coalesce("feed.fields.location", F.lit(False)).alias("filter_location"),
    )


def owner_for_site(configs: DataFrame, sites: DataFrame, default: str = K.DEFAULT_OWNER) -> DataFrame:
    """Add ``owner_id`` of the config's site, the default owner where the site names none."""
    owners = sites.groupBy(F.col("id").alias("_site")).agg(F.min(F.nullif(F.col("userId"), F.lit(""))).alias("_owner"))
    joined = configs.join(owners, F.col("site_id") == F.col("_site"), "left")
    return joined.withColumn("owner_id", F.coalesce("_owner", F.lit(default))).drop("_site", "_owner")


def require_title(df: DataFrame, title: str = "job_title") -> DataFrame:
    return df.filter(strip_space(F.coalesce(F.col(title), F.lit(""))) != "")


def keep_records(df: DataFrame, filter_location: bool | str = False) -> DataFrame:
    """Records with a title and, where asked, a location in Canada or the United States.

    ``filter_location`` is a fixed choice or the name of a boolean column.
    """
    titled = require_title(df)
    if isinstance(filter_location, str):
        return titled.filter(~F.col(filter_location) | is_canada_us(F.col("location")))
    return titled.filter(is_canada_us(F.col("location"))) if filter_location else titled


def cap_per_group(df: DataFrame, group: str | list[str], order, n: int = K.FEED_CAP, rank: str | None = None) -> DataFrame:
    return top_n(df, group, order, n, rank)


def take_first(df: DataFrame, n: int, order, listing: str = "listing_id") -> DataFrame:
    """The first n kept rows of every listing; apply it after the filters."""
    return top_n(df, listing, order, n)


def link_limit(max_jobs: int) -> int:
    """Links collected for a wanted number of jobs."""
    return max(max_jobs * 6, max_jobs + 12)


def buffer_links(links: DataFrame, max_jobs: int, chunk: str = "chunk_no", place: str = "place") -> DataFrame:
    """Enough links per listing to fill ``max_jobs``, each once.

    A chunk gives at most the limit, and is read only while the chunks before it gave fewer than that.
    """
    limit = link_limit(max_jobs)
    capped = top_n(ordered_distinct(links, ["listing_id", chunk, "url"], place), ["listing_id", chunk], place, limit)
    placed = capped.select("listing_id", "url", F.struct(chunk, place).alias("place"))
    firsts = ordered_distinct(placed, ["listing_id", "url"], "place")
    # rank() counts the links of earlier chunks, so a chunk is read whole or not at all.
    before = F.rank().over(Window.partitionBy("listing_id").orderBy(f"place.{chunk}"))
    return firsts.withColumn("_rank", before).filter(F.col("_rank") <= limit).select("listing_id", "url", "place")


def prefer_larger_run(df: DataFrame, listing: str, run: str) -> DataFrame:
    """Rows of the larger run per listing; the earlier run wins a tie."""
    sizes = df.groupBy(listing, run).agg(F.count(F.lit(1)).alias("_n"))
    best = sizes.groupBy(listing).agg(F.max_by(F.col(run), F.struct(F.col("_n"), -F.col(run))).alias(run))
    return df.join(best, [listing, run], "left_semi")


def ingest_summary(df: DataFrame, config: str = "config_id", feed: str = "feed_url") -> DataFrame:
    """Scraped, new and saved rows per feed, per config and in total."""
    return df.rollup(config, feed).agg(
        F.count(F.lit(1)).alias("scraped"),
        F.count_if(F.col("is_new")).alias("new"),
        F.count_if(F.col("is_saved")).alias("saved"),
        F.grouping_id().alias("level"),
    )
