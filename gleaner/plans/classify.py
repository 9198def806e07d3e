"""Categories for stored posts, asked from a model, and the update of the posts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.staging import settled
from gleaner.functions.text import strip_code_fence
from gleaner.operators.taxonomy import category_prompt, classify_posts
from gleaner.sources.answers import with_answers
from gleaner.sources.posts import read_posts, update_posts
from gleaner.sources.sinks import apply_category_updates

ASK = "Pick the one category of this list that the job below belongs to. Answer with a JSON object that holds category_id and category_name.\n"


def read_category_answer(df: DataFrame, response: str = "response") -> DataFrame:
    """Replace the answer by ``category_id`` and ``category_name``; both are empty where it is no JSON object."""
    staged = settled(df, {"_doc": F.try_parse_json(strip_code_fence(F.col(response), any_fence=False))})
    is_object = F.coalesce(F.startswith(F.schema_of_variant("_doc"), F.lit("OBJECT")), F.lit(False))

    def value(*names: str):
        found = [F.nullif(F.try_variant_get(F.col("_doc"), f"$.{name}", "string"), F.lit("")) for name in names]
        return F.when(is_object, F.coalesce(*found, F.lit(""))).otherwise(F.lit(""))

    return staged.withColumns({"category_id": value("category_id"), "category_name": value("category_name", "category")}).drop("_doc", response)


def classify_with_model(posts: DataFrame, categories: DataFrame, open_model: Callable[[], Callable], answers: str | None = None, **calls) -> DataFrame:
    """``id, category_id, category_name`` of the posts: the model's choice where it is one of the list, else what the rules find.

    ``answers`` is a folder that keeps the answers over runs; ``calls`` says how the model is called, see ``with_answers``.
    """
    options = category_prompt(categories).scalar()

    def detect(texts: DataFrame) -> DataFrame:
        asked = texts.withColumn("prompt", F.concat(F.lit(ASK + "Categories:\n"), options, F.lit("\nJob:\n"), "prompt"))
        return read_category_answer(with_answers(asked, open_model, answers, **calls))

    return classify_posts(posts, categories, detect)


def classify_stored(spark: SparkSession, path: str, categories: DataFrame, open_model: Callable[[], Callable], run_ts: datetime, answers: str | None = None, **calls) -> int:
    """Classify the stored posts and rewrite those whose category changes; returns how many."""
    posts = read_posts(spark, path)
    found = classify_with_model(posts, categories, open_model, answers, **calls)
    old = posts.select("id", F.col("categoryId").alias("old"))
    new = F.col("category_id").try_cast("int")
    changed = found.join(old, "id").filter(new.isNotNull() & ~new.eqNullSafe(F.col("old")))
    return update_posts(spark, path, changed, run_ts)


def classify_and_update(posts: DataFrame, categories: DataFrame, open_model: Callable[[], Callable[[str], str]], run_ts: datetime) -> DataFrame:
    """The posts with the categories found for them; see ``apply_category_updates``."""
    return apply_category_updates(posts, classify_with_model(posts, categories, open_model), run_ts)
