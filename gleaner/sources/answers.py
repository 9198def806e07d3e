"""A model's answers, asked for once per prompt and kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.records import ask_model
from gleaner.session import checkpoint_dir, drop_table, write_table
from gleaner.sources.versions import VersionedTables


def with_answers(
    df: DataFrame, open_model: Callable, path: str | None = None, prompt: str = "prompt", out: str = "response", parallel: int = 1, batched: bool = False, slices: int = 1
) -> DataFrame:
    """Replace the prompt by the model's answer; NULL where the prompt is or the call failed.

    Equal prompts are one call. Answers are kept by the prompt's hash in the folder ``path`` (without one, in a folder of this run's own), so
    a later run over it asks only what is new, and reads only the buckets of its prompts. New prompts are asked in ``slices``; what a
    slice answered stays if a later one fails. A failed call keeps nothing and is asked again by the next run. ``open_model``,
    ``parallel`` and ``batched`` are those of ``ask_model``. The frame is written first, so what led to the prompts is worked out once.
    """
    spark = df.sparkSession
    tables = VersionedTables(spark, path or f"{checkpoint_dir(spark).rstrip('/')}/answers-{uuid.uuid4().hex}", {"answers": "prompt_hash"})
    rows = write_table(df.withColumn("_prompt_hash", F.sha2(F.col(prompt), 256)))
    wanted = rows.select(F.col("_prompt_hash").alias("prompt_hash"), F.col(prompt).alias("asked")).filter("asked IS NOT NULL").dropDuplicates(["prompt_hash"])
    wanted = write_table(wanted)
    version = tables.latest()
    known = tables.read("answers", tables.files(version, "answers", wanted.select("prompt_hash")))
    new = wanted if known is None else wanted.join(known.select("prompt_hash"), "prompt_hash", "left_anti")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part in range(slices):
        # By number, so that a handful of prompts is not one task's work.
        asked = new.filter(F.pmod(F.xxhash64("prompt_hash"), F.lit(slices)) == part).repartition(tasks, "prompt_hash")
        answers = asked.select("prompt_hash", ask_model(F.col("asked"), open_model, parallel, batched).alias("answer")).filter("answer IS NOT NULL")
        files = tables.stage("answers", answers, version)
        if files:
            version = tables.publish(version, {"answers": files})
    found = tables.read("answers", tables.files(version, "answers", wanted.select("prompt_hash")))
    drop_table(wanted)
    kept = rows.drop(prompt)
    if found is None:
        return kept.withColumn(out, F.lit(None).cast("string")).drop("_prompt_hash")
    found = found.select(F.col("prompt_hash").alias("_found"), F.col("answer").alias(out))
    return kept.drop(out).join(found, F.col("_prompt_hash") == F.col("_found"), "left").drop("_prompt_hash", "_found")
