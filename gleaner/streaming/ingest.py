"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from gleaner import constants as K
from gleaner.functions.staging import settled
from gleaner.functions.urls import url_key
from gleaner.operators.dedupe import anti_keys, first_per_key
from gleaner.operators.ingest import keep_records
from gleaner.operators.spillover import cap_with_spillover
from gleaner.session import cut_lineage
from gleaner.sources.posts import append_posts, known_pages
from gleaner.sources.tables import delete_folder, list_folders


def read_arrivals(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_first_per_key(stream: DataFrame, url: str = "url", event_time: str | None = None, delay: str = "7 days") -> DataFrame:
    """Each page identity once; the seen keys live in the checkpoint.

    With an ``event_time`` column, a key is forgotten once the stream is ``delay`` past it, so the state holds the keys of that span and no
    more. Rows that come later than the delay are left out, as nobody can tell any more whether they repeat. Without one, keys are
    kept for the life of the stream.
    """
    keyed = stream.withColumn("url_key", url_key(F.col(url)))
    if event_time is None:
        return keyed.dropDuplicates(["url_key"])
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url_key"])


class IngestRun:
    """A run in progress: first arrivals go to the backlog, then, once per run, the backlog is offered to the caps."""

    def __init__(self, query: StreamingQuery, store: Callable[[], None]):
        self.query, self._store = query, store

    def awaitTermination(self) -> None:  # noqa: N802 - named as in the streaming query it stands for
        self.query.awaitTermination()
        self._store()


def incremental_ingest(
    stream: DataFrame,
    posts_path: str,
    checkpoint: str,
    run_ts: datetime,
    group: str = "feed_url",
    order: str = "pos",
    n: int = K.FEED_CAP,
    filter_location: bool | str = False,
    backlog: str | None = None,
    default_owner: str = K.DEFAULT_OWNER,
) -> IngestRun:
    """Take in all arrived records, then append to the posts what the caps of this run let through. Await the returned run.

    ``stream`` carries records with ``source_url``, the group and the order column. Records with a title (and place, where asked) wait
    in the ``backlog`` folder until they are stored: those behind the cap of ``n`` per group are offered again by the next run.
    The cap counts per run, however many batches the arrivals came in; a page that several groups list and whose first group is full
    goes to the next one. A batch writes one folder named by its number, so a repeated batch replaces its own; a run that fails
    later finds stored pages among the posts and adds nothing twice.
    """
    folder = (backlog or checkpoint.rstrip("/") + "-backlog").rstrip("/")

    def take_in(batch: DataFrame, number: int) -> None:
        usable = keep_records(batch.filter("source_url <> ''"), filter_location)
        usable.write.mode("overwrite").parquet(f"{folder}/arrived-{number}")

    def store() -> None:
        spark = stream.sparkSession
        parts = list_folders(spark, folder)
        if not parts:
            return
        # Settled, so that each page identity is worked out once and not again in each filter.
        waiting = settled(spark.read.schema(stream.schema).parquet(*parts), {"_page": url_key(F.col("source_url"))})
        # Only the buckets of the waiting pages are read, and none of the posts.
        waiting = anti_keys(waiting, known_pages(spark, posts_path, waiting.select("_page")), "_page")
        waiting = cut_lineage(first_per_key(waiting, [group, "_page"], order))
        saved = cut_lineage(cap_with_spillover(waiting, [group], "_page", order, n).select(group, "_page"))
        append_posts(waiting.join(saved, [group, "_page"], "left_semi").drop("_page"), posts_path, run_ts, default_owner)
        left = waiting.join(saved.select("_page"), "_page", "left_anti").select(*stream.columns)
        left.write.mode("overwrite").parquet(f"{folder}/waiting-{uuid.uuid4().hex}")
        for part in parts:
            delete_folder(spark, part)

    query = (
        stream.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    return IngestRun(query, store)
