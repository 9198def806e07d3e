"""Writing posts, snapshots and reports."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner import constants as K
from gleaner.functions.records import visible_columns
from gleaner.functions.text import strip_space
from gleaner.functions.urls import page_slug
from gleaner.operators.paging import narrowed
from gleaner.operators.shape import ensure_columns
from gleaner.sources.tables import file_names, publish_text


def apply_category_updates(posts: DataFrame, updates: DataFrame, run_ts: datetime) -> DataFrame:
    """Posts with new category ids and update times; ``updates`` holds ``id, category_id``.

    Also adds ``was_updated``, so the caller can count the changed rows.
    """
    posts = ensure_columns(posts, StructType.fromDDL("categoryId int, updatedAt timestamp_ntz"))
    new = updates.select(F.col("id").alias("_id"), strip_space(F.col("category_id")).try_cast("int").alias("_category"))
    new = new.filter(F.col("_category").isNotNull()).groupBy("_id").agg(F.max("_category").alias("_category"))
    now = F.lit(run_ts.isoformat(sep=" ")).cast("timestamp_ntz")
    joined = posts.join(new, F.col("id") == F.col("_id"), "left")
    return joined.withColumns(
        {
            "categoryId": F.coalesce("_category", "categoryId"),
            "updatedAt": F.when(F.col("_category").isNotNull(), now).otherwise(F.col("updatedAt")),
            "was_updated": F.col("_category").isNotNull(),
        }
    ).drop("_id", "_category")


def write_version(df: DataFrame, root: str, version: str) -> str:
    """Write to a fresh version folder, so readers of earlier versions are not disturbed."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def save_state(urls: DataFrame, records: DataFrame, root: str, run_ts: datetime) -> str:
    """Snapshot of the known URLs and the records of a run. It counts once both are written, in one step."""
    version = run_ts.strftime("%Y%m%dT%H%M%S")
    stamp = F.lit(run_ts.isoformat(sep=" ")).cast("timestamp_ntz").alias("saved_at")
    write_version(urls.select("source_url", stamp), f"{root.rstrip('/')}/urls", version)
    write_version(records.select("*", stamp), f"{root.rstrip('/')}/records", version)
    publish_text(urls.sparkSession, f"{root.rstrip('/')}/complete/{version}", version)
    return version


def load_state(spark: SparkSession, root: str, version: str | None, record_schema: StructType) -> tuple[DataFrame, DataFrame] | None:
    """The frames of a saved version, the latest one if none is named; None when it was never completed."""
    complete = file_names(spark, f"{root.rstrip('/')}/complete")
    version = max(complete, default=None) if version is None else version
    if version not in complete:
        return None
    urls = spark.read.schema("source_url string, saved_at timestamp_ntz").parquet(f"{root.rstrip('/')}/urls/version={version}")
    schema = StructType([*record_schema.fields, *StructType.fromDDL("saved_at timestamp_ntz").fields])
    return urls, spark.read.schema(schema).parquet(f"{root.rstrip('/')}/records/version={version}")


def csv_projection(df: DataFrame) -> DataFrame:
    """The report's 18 columns under their headings; absent fields are empty."""
    return df.select(
        *[
            (F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")).alias(heading)
            for name, heading in K.CSV_HEADINGS.items()
        ]
    )


def export_csv(df: DataFrame, folder: str, day: date) -> str:
    path = f"{folder.rstrip('/')}/job-results-{day.isoformat()}.csv"
    csv_projection(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def to_response_json(df: DataFrame, include_html: bool = False) -> DataFrame:
    """One JSON text per record without empty fields; html only on request."""
    if include_html:
        html = F.coalesce("html_content", F.lit("")) if "html_content" in df.columns else F.lit("")
        return df.withColumn("html_content", html).select(F.to_json(F.struct("*")).alias("json"))
    kept = df.drop("html_content")
    return kept.select(F.to_json(F.struct(*visible_columns(kept))).alias("json"))


def snapshot_pages(pages: DataFrame, path: str, page_type: str, run_ts: datetime) -> None:
    """Keep the raw html of fetched pages under a file-safe name."""
    if not re.fullmatch(r"[\w-]+", page_type):
        raise ValueError("page_type names a folder: letters, digits, _ and - only")
    stamp = run_ts.strftime("%Y%m%d_%H%M%S")
    name = F.concat(F.lit(f"{page_type}_"), page_slug(F.col("url")), F.lit(f"_{stamp}.html"))
    rows = pages.select("url", "html", name.alias("file_name"), F.lit(page_type).alias("page_type"))
    rows.write.mode("append").partitionBy("page_type").parquet(path)


def sort_key(field: str) -> Column:
    return F.collate(F.coalesce(F.col(field).cast("string"), F.lit("")), "UNICODE")


def _sorting(field: str, descending: bool, tie: str) -> list[Column]:
    key = sort_key(field)
    return [key.desc() if descending else key.asc(), F.col(tie)]


def sort_by_field(df: DataFrame, field: str | None, descending: bool = False, tie: str = "id") -> DataFrame:
    """Rows sorted by a field; in the order they came in where no field is named."""
    return df if field is None else df.orderBy(*_sorting(field, descending, tie))


def page_of(
    df: DataFrame, page: int, field: str, descending: bool = False, tie: str = "id", size: int = 10
) -> DataFrame:
    """One page of the sorted frame, with ``total_pages``.

    Ranges of keys are counted until few rows are left that can be on the page, and only those are sorted, see ``narrowed``. Rows that agree
    in field and ``tie`` are ordered by a hash of the row, so pages neither share nor lose rows.
    """
    total = df.count()
    hashable = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant", "struct", "array")]
    row = F.xxhash64(*hashable) if hashable else F.lit(0)
    first = (page - 1) * size
    part, before = narrowed(df, [(sort_key(field), descending), (F.col(tie), False), (row, False)], first, first + size - 1, total)
    rows = part.orderBy(*_sorting(field, descending, tie), row).offset(first - before).limit(size)
    return rows.withColumn("total_pages", F.lit(-(-total // size)).cast("long"))
