"""What the operators share: clean inputs, tables in the shared folder, code on the executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import checkpoint_dir, ship_package

BATCH_ROWS = 500
SPACES = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Executors get this package, and texts go to Python in small batches: a row may be large."""
    ship_package(spark, Path(__file__).resolve().parents[1].name)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever else the table holds; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def settle(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and continue from the files.

    This cuts the lineage, keeps columns apart for later reads and survives lost executors. The folder is the one the cluster
    names in ``spark.checkpoint.dir``; its owner clears it, like checkpoints.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> Column:
    """A number for a row's id and whole text: rows that agree in both share it, others don't but for 64-bit accidents."""
    return F.xxhash64(F.col(id_col).cast("long"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows whose ``row_key`` is not in ``gone`` (its only column), with their columns."""
    marked = docs.withColumn("_row_key", row_key(id_col, text_col))
    return marked.join(gone.toDF("_gone").distinct(), F.col("_row_key") == F.col("_gone"), "left_anti").drop("_row_key")


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session; work that is split by hand is split in as many parts or more."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def part_of(*cols: str | Column, parts: int) -> Column:
    """A number from 0 to ``parts`` - 1 that depends on these columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int")


def runs_by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key from batches that are sorted by it; a key's rows may lie in several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), batch.num_rows]
        if held and held[0].column(key)[0].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        for low, high in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(low, high - low)
            if high < batch.num_rows:
                yield pa.Table.from_batches([*held, part])
                held = []
            else:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)
