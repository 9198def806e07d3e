"""Columns that may go by several names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from gleaner import constants as K
from gleaner.functions.text import blank_to_null, strip_space


def present(df: DataFrame, names: list[str]) -> list[str]:
    """The given names that are columns of the frame; spelling counts."""
    return [name for name in names if name in df.columns]


def first_filled(df: DataFrame, names: list[str]) -> Column:
    """First non-empty value among the columns that exist, as text; NULL when none is filled."""
    found = [blank_to_null(F.col(name).cast("string")) for name in present(df, names)]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def alias_coalesce(df: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """One column per entry: the first filled alternative, '' when there is none."""
    return df.select(*[F.coalesce(first_filled(df, names), F.lit("")).alias(out) for out, names in mapping.items()])


def ensure_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """Add the columns of the schema that the frame lacks, as NULLs."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def category_table(df: DataFrame) -> DataFrame:
    """``id, name, parent_id, active`` from a category table under any of its spellings."""
    parents, flags = present(df, K.CATEGORY_PARENT_KEYS), present(df, K.CATEGORY_ACTIVE_KEYS)
    if not flags:
        active = F.lit(True)
    elif isinstance(df.schema[flags[0]].dataType, StringType):
        active = ~F.lower(strip_space(F.col(flags[0]))).isin(K.INACTIVE_WORDS)
    elif isinstance(df.schema[flags[0]].dataType, BooleanType):
        active = F.col(flags[0])
    else:
        active = F.col(flags[0]) != 0
    category_id = first_filled(df, K.CATEGORY_ID_KEYS)
    return df.select(
        F.coalesce(category_id, F.lit("")).alias("id"),
        F.coalesce(first_filled(df, K.CATEGORY_NAME_KEYS), category_id, F.lit("")).alias("name"),
        F.coalesce(first_filled(df, parents[:1]), F.lit("")).alias("parent_id"),
        F.coalesce(active, F.lit(False)).alias("active"),
    )


def geo_table(df: DataFrame) -> DataFrame:
    """``id, name, code, parent_id`` from a country/state table under any of its spellings."""
    return df.select(
        F.col("id").cast("string").alias("id"),
        F.coalesce(first_filled(df, K.GEO_NAME_KEYS), F.lit("")).alias("name"),
        F.coalesce(first_filled(df, K.GEO_CODE_KEYS), F.lit("")).alias("code"),
        first_filled(df, K.GEO_PARENT_KEYS).alias("parent_id"),
    )
