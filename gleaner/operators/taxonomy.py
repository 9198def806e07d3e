"""Choosing one category per job from a two-level taxonomy.

Dimension joins carry no broadcast hint: Spark broadcasts them while their measured size is small
and shuffles them, with skew splitting, beyond that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.staging import settled
from gleaner.functions.taxonomy import is_low_information, job_prompt, job_text
from gleaner.functions.text import blank_to_null, strip_space
from gleaner.operators.mentions import first_mention
from gleaner.operators.ranking import global_position
from gleaner.operators.shape import alias_coalesce, category_table
from gleaner.session import cut_lineage


def _named(name: Column, names: list[str]) -> Column:
    return F.lower(strip_space(name)).isin(names)


def category_place(name: str = "name", category_id: str = "id") -> Column:
    """Sortable place of a category: Other last, then by name, then by id."""
    return F.struct(
        _named(F.col(name), K.OTHER_NAMES).alias("is_other"),
        F.lower(name).alias("lname"),
        F.col(category_id).alias("id"),
        F.col(name).alias("name"),
    )


def selectable_categories(categories: DataFrame) -> DataFrame:
    """Active child rows; every active row when the table has no child rows at all."""
    usable = category_table(categories).filter((F.col("id") != "") & F.col("active"))
    has_children = F.coalesce(usable.agg(F.max(F.col("parent_id") != "")).scalar(), F.lit(False))
    return usable.filter((F.col("parent_id") != "") | ~has_children)


def rank_categories(categories: DataFrame) -> DataFrame:
    """Selectable categories numbered in their fixed order."""
    return global_position(
        selectable_categories(categories).withColumn("_place", category_place()), "_place", "rank"
    ).drop("_place")


def category_parent_name(categories: DataFrame) -> DataFrame:
    """``id, name, parent_name`` for every category; '' without a parent row."""
    table = category_table(categories)
    parents = table.filter("id != ''").groupBy(F.col("id").alias("_pid")).agg(F.min("name").alias("parent_name"))
    joined = table.join(parents, F.col("parent_id") == F.col("_pid"), "left")
    return joined.select("id", "name", "parent_id", F.coalesce("parent_name", F.lit("")).alias("parent_name"))


def category_prompt(categories: DataFrame) -> DataFrame:
    """One text listing the selectable categories in order, for a model prompt."""
    parents = category_parent_name(categories).groupBy(F.col("id").alias("_id")).agg(F.min("parent_name").alias("parent_name"))
    rows = selectable_categories(categories).join(parents, F.col("id") == F.col("_id"), "left")
    parent_part = F.when(F.col("parent_name") != "", F.concat(F.lit("; parent: "), "parent_name")).otherwise("")
    line = F.concat(F.lit("- id: "), "id", F.lit("; name: "), "name", parent_part)
    listed = rows.agg(
        F.sort_array(F.collect_list(F.struct(category_place().alias("place"), line.alias("line")))).alias("lines"),
        F.max(_named(F.col("name"), K.OTHER_NAMES)).alias("has_other"),
    )
    text = F.array_join(F.transform("lines", lambda item: item.line), "\n")
    note = F.when(F.col("has_other"), F.lit("\n\n" + K.OTHER_CATEGORY_NOTE)).otherwise("")
    return listed.select(
        F.when(F.size("lines") == 0, F.lit(K.NO_CATEGORIES_TEXT)).otherwise(F.concat(text, note)).alias("prompt")
    )


def match_category_exact(jobs: DataFrame, selectable: DataFrame, out: str = "exact") -> DataFrame:
    """First category in order whose id or name equals what was extracted.

    Two equi joins and the smaller place replace a join on id-or-name, which Spark could only loop over.
    """
    placed = selectable.withColumn("_place", category_place())
    by_id = placed.groupBy(F.lower("id").alias("_by_id")).agg(F.min("_place").alias("_id_place"))
    by_name = placed.groupBy(F.lower("name").alias("_by_name")).agg(F.min("_place").alias("_name_place"))

    def wanted(*names: str) -> Column:
        found = [blank_to_null(F.col(n).cast("string")) for n in names if n in jobs.columns]
        return blank_to_null(F.lower(strip_space(F.coalesce(*found)))) if found else F.lit(None).cast("string")

    keyed = jobs.withColumns({"_want_id": wanted("category_id"), "_want_name": wanted("category_name", "category")})
    joined = keyed.join(by_id, F.col("_want_id") == F.col("_by_id"), "left").join(
        by_name, F.col("_want_name") == F.col("_by_name"), "left"
    )
    return joined.withColumn(out, F.least("_id_place", "_name_place")).drop(
        "_want_id", "_want_name", "_by_id", "_by_name", "_id_place", "_name_place"
    )


def match_category_mention(jobs: DataFrame, selectable: DataFrame, text: Column, out: str = "mentioned", where: Column | None = None) -> DataFrame:
    """First category in order whose name occurs in the text, NULL where none does or ``where`` does not hold.

    Equal texts are searched once, whatever number of jobs has them.
    """
    # Half of the hash, in bytes: the keys are most of what is shuffled.
    hashed = jobs.withColumn("_text_hash", F.substring(F.unhex(F.sha2(text if where is None else F.when(where, text), 256)), 1, 16))
    texts = hashed.filter(F.col("_text_hash").isNotNull()).select(F.col("_text_hash").alias("key"), text.alias("text"))
    places = selectable.filter("name != ''").select(category_place().alias("place"))
    found = first_mention(texts, places.select("place.lname", "place")).select(F.col("key").alias("_found_hash"), F.col("place").alias(out))
    joined = hashed.drop(out).join(found, F.col("_text_hash") == F.col("_found_hash"), "left")
    return joined.drop("_text_hash", "_found_hash")


def assign_category(jobs: DataFrame, categories: DataFrame | None) -> DataFrame:
    """Set ``category_id`` and ``category_name``: test rows, exact match, mention, Other, nothing."""
    if categories is None:
        return jobs.withColumns({"category_id": F.lit(""), "category_name": F.lit("")})
    # The dimension is read in four places below; written once, its source is worked out once.
    selectable = cut_lineage(selectable_categories(categories))
    kept = [name for name in jobs.columns if name not in ("category_id", "category_name")]
    place = category_place()
    fixed = selectable.agg(
        F.struct(
            F.min(F.when(_named(F.col("name"), K.TEST_NAMES), place)).alias("test"),
            F.min(F.when(_named(F.col("name"), K.OTHER_NAMES), place)).alias("other"),
        )
    ).scalar()
    staged = match_category_exact(jobs, selectable, "_exact").withColumns({"_fixed": fixed, "_text": job_text(jobs.columns)})
    for_tests = F.when(is_low_information(F.col("_text")), F.coalesce("_fixed.test", "_fixed.other"))
    # Settled, so that what follows reads these values and does not work them out again.
    staged = settled(staged, {"_sure": F.coalesce(for_tests, "_exact")})
    held = match_category_mention(staged, selectable, F.col("_text"), "_mentioned", F.col("_sure").isNull())
    found = held.withColumn("_found", F.coalesce("_sure", "_mentioned", "_fixed.other")).select(*kept, "_found")
    return found.withColumns(
        {"category_id": F.coalesce("_found.id", F.lit("")), "category_name": F.coalesce("_found.name", F.lit(""))}
    ).drop("_found")


POST_TEXT_ALIASES = {
    "job_title": ["job_title", "jobTitle"],
    "job_description": ["job_description", "description"],
    "key_responsibilities": ["key_responsibilities", "keyResponsibilities"],
    "qualifications_and_skills": ["qualifications_and_skills", "qualifications"],
    "educational_level": ["educational_level", "educationLevel"],
    "certification_level": ["certification_level", "certificationLevel"],
    "required_experience": ["required_experience", "requiredExperience"],
}


def classify_posts(
    posts: DataFrame, categories: DataFrame, detect: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``id, category_id, category_name`` for stored posts.

    ``detect`` may add ``category_id``/``category_name`` guesses to rows of ``id`` + text fields + ``prompt``.
    """
    texts = alias_coalesce(posts, {"id": ["id"], **POST_TEXT_ALIASES})
    if detect is not None:
        texts = detect(texts.withColumn("prompt", job_prompt(texts.columns)))
    return assign_category(texts, categories).select("id", "category_id", "category_name")
