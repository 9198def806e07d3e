"""The scheduled run: feeds in, new posts and counts out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.records import post_rows
from gleaner.functions.staging import settled
from gleaner.functions.urls import url_key
from gleaner.operators.dedupe import anti_known, anti_known_raw, first_per_key, known_urls
from gleaner.operators.ingest import explode_feeds, ingest_summary, keep_records, owner_for_site
from gleaner.operators.spillover import cap_with_spillover
from gleaner.session import cut_lineage

# Configs with other ids by their text, then those whose ids are numbers by these.
FEED = ["config_no", "config_id", "feed_pos"]


def scheduled_ingest(
    configs: DataFrame,
    sites: DataFrame,
    links: DataFrame,
    records: DataFrame,
    posts: DataFrame,
    run_ts: datetime,
    n: int = K.FEED_CAP,
) -> tuple[DataFrame, DataFrame]:
    """Posts to append and the counts per feed, config and run.

    ``links``: ``feed_url, url, pos`` found on each feed. ``records``: extracted records by ``source_url``.
    ``posts``: the stored posts. Stored pages go out first, the cap comes last. A page that an earlier feed saved is not scraped
    again, so it counts for that feed alone.
    """
    feeds = owner_for_site(explode_feeds(configs), sites).withColumn("config_no", F.coalesce(F.col("config_id").try_cast("long"), F.lit(-1).cast("long")))
    known = known_urls(posts, K.SOURCE_URL_ALIASES)
    # Settled, as the optimizer would work the identity out once more in each filter, and do so before a table is spread. Ahead of the join,
    # as a few feeds' names leave few tasks.
    links = settled(links, {"url_key": url_key(F.col("url"))}).filter("url_key <> ''")
    listed = feeds.withColumn("_feed_key", url_key(F.col("feed_url"))).join(links, "feed_url")
    listed = listed.filter(F.col("url_key") != F.col("_feed_key")).drop("_feed_key")
    fresh = anti_known(first_per_key(listed, [*FEED, "url_key"], "pos"), known, key="url_key")

    by_key = settled(records, {"url_key": url_key(F.col("source_url"))})
    by_key = first_per_key(by_key, "url_key", "source_url")
    scraped = cut_lineage(keep_records(fresh.join(by_key, "url_key"), "filter_location"))
    new = anti_known_raw(scraped, known, "source_url")
    saved = cut_lineage(cap_with_spillover(new, FEED, "url_key", "pos", n).select(*FEED, "url_key"))

    rows = new.join(saved, [*FEED, "url_key"], "left_semi").withColumns(
        {"micrositeId": F.col("site_id"), "siteId": F.col("site_id"), "postedById": F.col("owner_id")}
    )
    feed = F.struct(*FEED)
    taken = saved.select("url_key", feed.alias("_taker"))
    stored = known.select(F.col("source_url").alias("_stored")).distinct()
    met = scraped.join(taken, "url_key", "left").filter(F.col("_taker").isNull() | (F.col("_taker") >= feed))
    marked = met.join(stored, F.col("source_url") == F.col("_stored"), "left").withColumns(
        {"is_saved": F.coalesce(F.col("_taker") == feed, F.lit(False)), "is_new": (F.col("source_url") != "") & F.col("_stored").isNull()}
    )
    return post_rows(rows, run_ts), ingest_summary(marked)
