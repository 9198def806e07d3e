"""The stored posts, and the pages they came from, as tables that change together."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.records import post_rows
from gleaner.functions.urls import url_key
from gleaner.operators.dedupe import anti_keys
from gleaner.session import drop_table, write_table
from gleaner.sources.sinks import apply_category_updates
from gleaner.sources.versions import BUCKETS, VersionedTables


def stored_posts(spark: SparkSession, path: str, buckets: int = BUCKETS) -> VersionedTables:
    """``posts`` by id and ``pages``, the identities of their pages, by themselves. ``buckets`` counts for tables without a version only."""
    return VersionedTables(spark, path, {"posts": "id", "pages": "page"}, buckets)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """All posts of the last version; an empty frame with their columns before the first."""
    tables = stored_posts(spark, path)
    found = tables.read("posts", tables.files(tables.latest(), "posts"))
    return post_rows(spark.createDataFrame([], "source_url string"), datetime(1970, 1, 1)) if found is None else found


def known_pages(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Those of the page identities in ``keys`` (first column) that have a post. Only the buckets of these keys are read, and no posts."""
    tables = stored_posts(spark, path)
    wanted = keys.select(F.col(keys.columns[0]).alias("page")).filter("page <> ''")
    found = tables.read("pages", tables.files(tables.latest(), "pages", wanted))
    return wanted.limit(0) if found is None else found.join(wanted, "page", "left_semi").distinct()


def append_posts(records: DataFrame, path: str, run_ts: datetime, default_owner: str = K.DEFAULT_OWNER, buckets: int = BUCKETS) -> int:
    """Append the records' posts and return how many were new; those whose id is stored add nothing, so a load can be repeated.

    Stored ids are looked up in the buckets of the new ids alone. Posts and page identities appear together, as one version; a load that
    fails before that leaves the last version as it was. ``buckets`` is fixed by the first load; many posts and small loads want many.
    """
    spark = records.sparkSession
    tables = stored_posts(spark, path, buckets)
    base = tables.latest()
    rows = write_table(post_rows(records, run_ts, default_owner).dropDuplicates(["id"]))
    stored = tables.read("posts", tables.files(base, "posts", rows.select("id")))
    fresh = rows if stored is None else rows.join(stored.select("id"), "id", "left_anti").select(*rows.columns)
    added = tables.stage("posts", fresh, base)
    number = 0
    if added:
        new = tables.read("posts", added)
        number = new.count()
        pages = new.select(url_key(F.col("source_url")).alias("page")).filter("page <> ''").distinct()
        pages = anti_keys(pages, known_pages(spark, path, pages), "page")
        tables.publish(base, {"posts": added, "pages": tables.stage("pages", pages, base)})
    drop_table(rows)
    return number


def update_posts(spark: SparkSession, path: str, updates: DataFrame, run_ts: datetime) -> int:
    """Give stored posts new categories (``id, category_id``) and return how many changed, see ``apply_category_updates``.

    The posts' files are found by the buckets of the ids, then by what they hold; only files with an updated post are rewritten, and
    the new version appears at once.
    """
    tables = stored_posts(spark, path)
    base = tables.latest()
    wanted = write_table(updates.select("id", "category_id").filter("id is not null"))
    touched = tables.holding("posts", tables.files(base, "posts", wanted), wanted)
    if touched:
        changed = write_table(apply_category_updates(tables.read("posts", touched), wanted, run_ts))
        tables.rewrite("posts", base, touched, lambda rows: changed.drop("was_updated"))
        number = changed.filter("was_updated").count()
        drop_table(changed)
    else:
        number = 0
    drop_table(wanted)
    return number
