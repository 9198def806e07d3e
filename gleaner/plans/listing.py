"""From listing pages to kept job records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.geo import standardize_location
from gleaner.functions.records import parse_model_record
from gleaner.functions.text import clamp, truncate_text
from gleaner.functions.urls import url_key
from gleaner.operators.dedupe import anti_known, drop_landing, first_per_key
from gleaner.operators.geo import match_country_state_ids
from gleaner.operators.ingest import buffer_links, keep_records, prefer_larger_run, take_first
from gleaner.operators.pages import job_details, job_links
from gleaner.operators.taxonomy import assign_category, category_prompt
from gleaner.session import write_table
from gleaner.sources.answers import with_answers

PROMPT_HEAD = "Read the job page below and answer with one JSON object holding these keys, null where unknown: "


def new_links(listings: DataFrame, known: DataFrame, max_jobs: int | None = None) -> DataFrame:
    """Job links of the listing pages that are not stored yet, in listing order.

    ``listings``: ``page_id, url, html`` and optionally ``chunk_no``. The stored pages go out before
    any detail page is read, which is where the cost lies.
    """
    links = job_links(listings)
    if max_jobs is None:
        placed = links.select("listing_id", "url", F.struct("chunk_no", "place").alias("place"))
    else:
        placed = buffer_links(links, max_jobs)
    # The listing's own address is that of its first document; frames of other addresses may follow.
    chunk = F.col("chunk_no") if "chunk_no" in listings.columns else F.lit(0)
    landing = listings.groupBy(F.col("page_id").alias("listing_id")).agg(F.min_by("url", F.struct(chunk, "url")).alias("_landing"))
    keyed = placed.withColumn("url_key", url_key(F.col("url"))).join(landing, "listing_id")
    first = first_per_key(drop_landing(keyed, F.col("_landing")).drop("_landing"), ["listing_id", "url_key"], "place")
    return anti_known(first, known, key="url_key")


def extraction_prompt(details: DataFrame, categories: DataFrame | None = None, out: str = "prompt") -> DataFrame:
    """Add the prompt for the extraction model; ``page_text`` is cut to the model's limit."""
    text = truncate_text(F.col("page_text"), K.JOB_TEXT_LIMIT)
    options = F.lit(K.NO_CATEGORIES_TEXT) if categories is None else category_prompt(categories).scalar()
    return details.withColumn(
        out,
        F.concat(
            F.lit(PROMPT_HEAD + ", ".join(K.MODEL_FIELDS) + "\nPage: "), "url", F.lit("\nCategories:\n"), options, F.lit("\nText:\n"), text
        ),
    )


PLACED = ["category_id", "category_name", "location", "city", "state", "country", "state_id", "country_id"]


def standard_records(parsed: DataFrame, categories: DataFrame | None = None, tree: DataFrame | None = None) -> DataFrame:
    """Categories and places of the records that came from readable answers; the others stay as they are. One row per row."""
    none = {name: F.lit(None).cast("string") for name in PLACED if name not in parsed.columns}
    raw = F.struct(*[none.get(name, F.col(name)).alias(name) for name in PLACED])
    placed = standardize_location(assign_category(parsed.withColumn("raw_places", raw), categories))
    placed = placed.withColumns({"state_id": none["state_id"], "country_id": none["country_id"]}) if tree is None else match_country_state_ids(placed, tree)
    chosen = {name: F.when(F.col("parsed"), F.col(name)).otherwise(F.col("raw_places")[name]).alias(name) for name in PLACED}
    return placed.withColumns(chosen).drop("raw_places")


def detail_records(
    details: DataFrame,
    open_model: Callable[[], Callable[[str], str]],
    categories: DataFrame | None = None,
    tree: DataFrame | None = None,
    include_html: bool = True,
    answers: str | None = None,
    **calls,
) -> DataFrame:
    """Job records of fetched detail pages (``page_id, url, html`` and any columns to keep), with their cleaned ``html_content`` unless
    ``include_html`` is false.

    Pages, prompts and answers are written before anything reads them, so each page is parsed once and each prompt asked once, however
    often the records are read. ``answers`` is a folder that keeps the answers over runs; ``calls`` says how the model is called, see
    ``with_answers``.
    """
    text = job_details(details, "page_text", "html_content" if include_html else None).drop("html")
    parsed = parse_model_record(with_answers(extraction_prompt(text, categories), open_model, answers, **calls)).withColumn("source_url", F.col("url"))
    return standard_records(parsed, categories, tree)


def kept_records(
    records: DataFrame, max_jobs: int | None, order, listing: str = "listing_id", filter_location: bool | str = False
) -> DataFrame:
    """Records that pass title and region, then the first few of every listing: the limit counts kept rows."""
    kept = keep_records(records, filter_location)
    if max_jobs is None:
        return kept
    return take_first(kept, max(1, min(max_jobs, K.API_MAX_JOBS)), order, listing)


def two_phase_records(
    shallow: DataFrame, deep: DataFrame, records_of: Callable[[DataFrame], DataFrame], max_jobs: int, order, listing: str = "listing_id", filter_location: bool | str = False
) -> DataFrame:
    """Kept records of the shallow run's pages; listings that came out short are run again on the deep run's pages, and the run with more
    records counts, the first of equals.

    ``records_of`` makes records of detail pages. Pages of listings that had enough are dropped before the second run parses or asks anything.
    """
    wanted = max(1, min(max_jobs, K.API_MAX_JOBS))
    first = write_table(kept_records(records_of(shallow), wanted, order, listing, filter_location).withColumn("_run", F.lit(1)))
    enough = first.groupBy(listing).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= wanted).select(listing)
    again = deep.join(enough, listing, "left_anti")
    second = kept_records(records_of(again), wanted, order, listing, filter_location).withColumn("_run", F.lit(2))
    return prefer_larger_run(first.unionByName(second, allowMissingColumns=True), listing, "_run").drop("_run")


def asked_jobs(requests: DataFrame, column: str = "max_jobs") -> DataFrame:
    """Requested job numbers within their bounds."""
    return requests.withColumn(column, clamp(F.col(column), 1, K.API_MAX_JOBS))
