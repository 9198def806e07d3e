"""Model output to records, records to posts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.staging import settled
from gleaner.functions.text import (
    collapse_blank_lines,
    deadline_or_default,
    first_int,
    strip_code_fence,
    strip_space,
    truncate_text,
)
from gleaner.functions.urls import url_key
from gleaner.operators.shape import first_filled


def ask_model(prompt: Column, open_model: Callable[[], Callable], parallel: int = 1, batched: bool = False) -> Column:
    """Answer per prompt from a caller's model; NULL where the call failed.

    ``open_model`` runs once per task and returns the function that answers one prompt or, if ``batched``, a list of them by a list of
    answers. A task has at most ``parallel`` calls under way at a time. Only the prompt column crosses to Python.
    """

    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = open_model()

        def answer(texts: list[str]) -> list[str | None]:
            try:
                found = list(model(texts)) if batched else [model(texts[0])]
                return found if len(found) == len(texts) else [None] * len(texts)
            except Exception:
                return [None] * len(texts)

        with ThreadPoolExecutor(parallel) as calls:
            for batch in batches:
                asked = batch[batch.notna()]
                size = max(1, -(-len(asked) // parallel)) if batched else 1
                parts = [asked.iloc[at : at + size].tolist() for at in range(0, len(asked), size)]
                found = [one for part in calls.map(answer, parts) for one in part]
                yield pd.Series(found, index=asked.index, dtype=object).reindex(batch.index)

    answers.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    # A model may answer otherwise the next time, so the optimizer must not copy the call.
    return F.pandas_udf(answers, "string").asNondeterministic()(prompt)


def extract_with_model(df: DataFrame, open_model: Callable[[], Callable], prompt: str = "prompt", out: str = "response") -> DataFrame:
    return df.withColumn(out, ask_model(F.col(prompt), open_model))


def _field(document: Column, name: str) -> Column:
    """Text of one field: lists by lines, objects as JSON, booleans capitalised, null as ''.

    The kind of a value is asked only where its text looks like a list or a boolean.
    """
    path = f"$.{name}"
    text = F.try_variant_get(document, path, "string")
    items = F.array_join(F.try_variant_get(document, path, "array<string>"), "\n", "None")
    is_flag = F.schema_of_variant(F.try_variant_get(document, path, "variant")) == "BOOLEAN"
    return (
        F.when(text.isNull(), F.lit(""))
        .when(F.startswith(text, F.lit("[")), F.coalesce(items, text))
        .when(text.isin("true", "false"), F.when(is_flag, F.initcap(text)).otherwise(text))
        .otherwise(text)
    )


def parse_model_record(df: DataFrame, response: str = "response", page_text: str = "page_text") -> DataFrame:
    """Replace the response column by the record fields and ``parsed``.

    Not JSON: an empty title. No answer, or JSON that is no object: the fixed title of a failed call.
    Both keep an excerpt of the page text as description.
    """
    text = strip_code_fence(F.col(response), any_fence=False)
    excerpt = truncate_text(F.coalesce(F.col(page_text), F.lit("")), K.EXCERPT_LIMIT)
    staged = settled(df, {"_doc": F.try_parse_json(text)}).withColumn(
        "parsed", F.coalesce(F.startswith(F.schema_of_variant("_doc"), F.lit("OBJECT")), F.lit(False))
    )
    unreadable = F.col(response).isNotNull() & F.col("_doc").isNull()
    fallback = {
        "job_title": F.when(unreadable, F.lit("")).otherwise(F.lit(K.FAILED_CALL_TITLE)),
        "job_description": excerpt,
    }
    fields = {
        name: F.when(F.col("parsed"), _field(F.col("_doc"), name)).otherwise(fallback.get(name, F.lit("")))
        for name in K.MODEL_FIELDS
    }
    return staged.withColumns(fields).drop("_doc", response)


def verbatim_or_rule(response: Column, rule: Column, field: str = "description") -> Column:
    """The model's text when it gave some, NULL when it said null, else the rule-based value."""
    document = F.try_parse_json(strip_code_fence(response))
    is_object = F.startswith(F.schema_of_variant(document), F.lit("OBJECT"))
    value = F.try_variant_get(document, f"$.{field}", "variant")
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(document, f"$.{field}", "string")
    return (
        F.when(~F.coalesce(is_object, F.lit(False)), rule)
        .when(value.isNull() | (kind == "VOID"), F.lit(None).cast("string"))
        .when((kind == "STRING") & (strip_space(text) != ""), collapse_blank_lines(text))
        .otherwise(rule)
    )


def post_id(site: Column, source_url: Column, record: Column | None = None) -> Column:
    """The same id for the same page of the same site; without a URL the ``record``'s content takes the page's place."""
    page = url_key(source_url)
    if record is not None:
        page = F.when(strip_space(source_url) != "", page).otherwise(record)
    return F.sha2(F.concat_ws("|", site, page), 256)


def post_rows(records: DataFrame, run_ts: datetime, default_owner: str = K.DEFAULT_OWNER) -> DataFrame:
    """The 31 stored columns of every record."""
    texts = {out: F.coalesce(first_filled(records, names), F.lit("")) for out, names in K.POST_ALIASES.items()}
    owner = first_filled(records, ["postedById"])
    now = F.lit(run_ts.isoformat(sep=" ")).cast("timestamp_ntz")
    shown = [F.col(f.name) for f in records.schema.fields if f.dataType.typeName() not in ("variant", "map")]
    key = post_id(texts["siteId"], texts["source_url"], F.to_json(F.struct(*shown)))
    columns = {
        "id": key,
        "employerName": texts["employerName"],
        "hideEmployer": F.lit(False),
        "jobTitle": texts["jobTitle"],
        "jobId": F.coalesce(first_filled(records, K.EXTERNAL_ID_ALIASES), key),
        "description": texts["description"],
        "location": texts["location"],
        "salaryRange": texts["salaryRange"],
        "applicationDeadline": deadline_or_default(first_filled(records, K.DEADLINE_ALIASES), run_ts),
        "image": texts["image"],
        "keyResponsibilities": texts["keyResponsibilities"],
        "qualifications": texts["qualifications"],
        "perksBenefits": texts["perksBenefits"],
        "preferredExperience": first_int(first_filled(records, K.EXPERIENCE_ALIASES)),
        "educationLevel": texts["educationLevel"],
        "certificationLevel": texts["certificationLevel"],
        "interviewFormat": texts["interviewFormat"],
        "postedById": F.coalesce(owner, F.lit(default_owner)),
        "channels": F.lit(None).cast("string"),
        "siteId": texts["siteId"],
        "isScrapped": F.lit(True),
        "active": F.lit(True),
        "createdAt": now,
        "updatedAt": now,
        "source_url": texts["source_url"],
        "htmlContent": texts["htmlContent"],
        "requiredExperience": texts["requiredExperience"],
        "categoryId": strip_space(first_filled(records, K.CATEGORY_ALIASES)).try_cast("int"),
        "city": texts["city"],
        "state": texts["state"],
        "country": texts["country"],
    }
    return records.select(*[column.alias(name) for name, column in columns.items()])


def visible_columns(df: DataFrame) -> list[Column]:
    """All columns, blank text as NULL, so JSON output leaves them out."""
    return [
        F.when(strip_space(F.col(f.name)) != "", F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name)
        for f in df.schema.fields
    ]
