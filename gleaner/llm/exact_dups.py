"""Exact duplicates: grouped by a 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import SPACES, texts


def normal_text(text: Column) -> Column:
    """Every run of ASCII white space as one space."""
    return F.regexp_replace(text, SPACES, " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normalised bytes are; of equal texts the row with the smallest id stays. The grouping key is the
    128-bit MD5 of the text *and* the text itself: Spark compares the bytes of rows with one hash, so two texts that collide stay
    two groups. Copies meet in the map-side aggregate first, and a group leaves each task as one row, so a text that is a third
    of the corpus costs one row per task. Texts are shuffled once; the way back to the rows joins on the two digests of the text,
    384 bits together, as a plain shuffle join that Spark splits where one key is hot.

    Null texts count as empty, and all empty texts are one group. Repeated rows (same id, same text) count each in ``group_size``
    and all carry ``kept`` if their id is the smallest. Null ids never win over another id; a group of null ids alone has a null
    ``keep_id`` and is kept. An empty table gives no rows. Other columns are not read.
    """
    rows = texts(docs, id_col, text_col).withColumn("text", normal_text(F.col("text")))
    keyed = rows.withColumn("hash128", F.md5("text"))
    groups = (
        keyed.groupBy("hash128", "text")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash128", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    narrow = keyed.select("doc_id", "hash128", F.sha2("text", 256).alias("text_sha256"))
    return narrow.join(groups, ["hash128", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns; of rows repeated with one id and text, one."""
    found = exact_duplicates(docs, id_col, text_col)
    away = found.where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")).distinct()
    digest = F.sha2(normal_text(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)
    marked = docs.withColumn("_digest", digest)
    stay = marked.join(away, marked[id_col].eqNullSafe(away["_id"]) & (marked["_digest"] == away["_digest"]), "left_anti")
    return stay.dropDuplicates([id_col, "_digest"]).drop("_digest")
