"""Category expressions over the job text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.text import blank_to_null


def job_text(columns: list[str]) -> Column:
    """Lower-cased text of the seven fields a category may be read from; absent fields are empty."""
    fields = [F.coalesce(F.col(f), F.lit("")) if f in columns else F.lit("") for f in K.CATEGORY_TEXT_FIELDS]
    return F.lower(F.concat_ws(" ", *fields))


def is_low_information(text: Column) -> Column:
    """Only test words: up to 8 tokens, or up to 4 besides filler words."""
    end = r"(?![a-z0-9])[^a-z0-9]*"
    noise = f"(?:{'|'.join(K.NOISE_TOKENS)}){end}"
    filler = f"(?:(?:{'|'.join(K.FILLER_TOKENS)}){end})*"
    telling = f"(?:{'|'.join(t for t in K.NOISE_TOKENS if t not in K.FILLER_TOKENS)}){end}"
    lowered = F.lower(text)
    return lowered.rlike(rf"^[^a-z0-9]*(?:{noise}){{1,8}}\z") | lowered.rlike(
        rf"^[^a-z0-9]*{filler}(?:{telling}{filler}){{1,4}}\z"
    )


def job_prompt(columns: list[str]) -> Column:
    """Labelled non-empty fields, one per line."""
    parts = [
        F.concat(F.lit(f"{label}: "), blank_to_null(F.col(name)))
        for name, label in K.PROMPT_LABELS.items()
        if name in columns
    ]
    return F.concat_ws("\n", *parts)
