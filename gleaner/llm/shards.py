"""Shards under a byte limit by extendible hashing: a directory of hash prefixes, of which only oversized ones split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import settle, texts

HASH_BITS = 60
LEVEL_BITS = 8


def id_hash(value: Column) -> Column:
    """60 evenly spread bits of the value's text, as a long of zero or more."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column, depth: int) -> Column:
    return F.shiftright(bits, HASH_BITS - depth) if depth else F.lit(0).cast("long")


def shard_rows(sized: DataFrame, max_bytes: int) -> DataFrame:
    """Add ``depth, shard, shard_bytes, shard_rows`` to rows with ``bits`` (60-bit hash) and ``n_bytes``.

    A bucket is a hash prefix; the directory starts with the empty prefix, and a bucket whose bytes exceed the limit splits on
    one more bit, until it fits or its rows share all 60 bits. A round looks at the next bits of all open buckets at once: rows are
    summed by their longest prefix of the round, map-side first, and only those sums, at most 2^8 for each open bucket, are
    summed again for each shorter prefix. Rows of a bucket that fits leave with its depth; rows of the others go on. The number
    of rounds is at most eight, whatever the size. The first round looks 8 bits further than an even spread needs.
    """
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    end = min(HASH_BITS, LEVEL_BITS + max(0, math.ceil(math.log2(max(1, total / max_bytes)))))
    begin, open_rows, closed = 0, sized, None
    while True:
        fine = open_rows.groupBy(_prefix(F.col("bits"), end).alias("fine")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(begin), F.lit(end)))).withColumn(
            "shard", F.expr(f"shiftright(fine, {end} - depth)")
        )
        sums = levels.groupBy("depth", "shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = sums.where((F.col("shard_bytes") <= max_bytes) | (F.col("depth") == HASH_BITS))
        leaf = (
            levels.join(fits, ["depth", "shard"])
            .groupBy("fine")
            .agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_rows")).alias("leaf"))
        )
        placed = settle(
            open_rows.withColumn("fine", _prefix(F.col("bits"), end)).join(leaf, "fine", "left").select(*sized.columns, "leaf.*")
        )
        done = placed.where(F.col("depth").isNotNull())
        closed = done if closed is None else closed.unionByName(done)
        open_rows = placed.where(F.col("depth").isNull()).select(*sized.columns)
        if end == HASH_BITS or open_rows.isEmpty():
            return closed
        begin, end = end + 1, min(HASH_BITS, end + LEVEL_BITS)


def shard_documents(docs: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, directory, depth, shard, part, shard_bytes, shard_rows, oversized``.

    A shard is named by ``directory, depth, shard, part``: a hash prefix ``shard`` of ``depth`` bits in one of two directories.
    ``shard_bytes`` and ``shard_rows`` say what it holds. Directory 0 hashes the id. Equal ids share every bit, so a bucket of one
    repeated id (or of null ids) can stay over the limit after 60 bits; its rows go to directory 1, which hashes id and text. Rows that
    repeat in id and text, too, are dealt to numbered parts that hold as many of them as fit. A single text longer than the limit
    stands in a part of its own, with ``oversized`` true. Null and empty texts have no bytes. An empty table gives no rows.
    Extra columns are not read.
    """
    rows = texts(docs, id_col, text_col)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    sized = rows.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        id_hash(name).alias("bits"),
        id_hash(F.concat_ws("/", name, F.md5("text"))).alias("bits1"),
    )
    first = shard_rows(settle(sized), max_bytes)
    fit = first.where(F.col("shard_bytes") <= max_bytes).withColumn("directory", F.lit(0)).withColumn("part", F.lit(0).cast("long"))
    tied = first.where(F.col("shard_bytes") > max_bytes).select("doc_id", "n_bytes", F.col("bits1").alias("bits"))
    out = ["doc_id", "n_bytes", "directory", "depth", "shard", "part", "shard_bytes", "shard_rows"]
    whole = fit.select(*out)
    if not tied.isEmpty():
        whole = whole.unionByName(_deal(shard_rows(tied, max_bytes), max_bytes).withColumn("directory", F.lit(1)).select(*out))
    return whole.withColumn("oversized", F.col("shard_bytes") > max_bytes)


def _deal(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Numbered parts for buckets whose rows agree in all bits, so in size; other buckets are one part.

    Which of the equal rows a part takes makes no difference, so a row's number comes from counts per task: rows are numbered inside
    a task's share of the bucket and shifted by the counts of the tasks before it.
    """
    settled = settle(rows.withColumn("task", F.spark_partition_id()))
    keys = ["depth", "shard"]
    per_task = settled.groupBy(*keys, "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("task")) - F.col("n")
    number = F.row_number().over(Window.partitionBy(*keys, "task").orderBy("doc_id")) - 1
    shifts = per_task.select(*keys, "task", before.alias("before"))
    numbered = settled.withColumn("at", number).join(shifts, [*keys, "task"]).withColumn("at", F.col("at") + F.col("before"))
    over = F.col("shard_bytes") > max_bytes
    fit = F.greatest(F.lit(1), F.floor(F.lit(max_bytes) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("long")
    part = F.when(over, F.floor(F.col("at") / fit)).otherwise(0).cast("long")
    here = F.when(over, F.least(fit, F.col("shard_rows") - F.col("part") * fit)).otherwise(F.col("shard_rows"))
    return (
        numbered.withColumn("part", part)
        .withColumn("shard_rows", here)
        .withColumn("shard_bytes", F.when(over, F.col("shard_rows") * F.col("n_bytes")).otherwise(F.col("shard_bytes")))
    )
