"""Stages of a computation that the optimizer keeps apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Set columns behind a one-row generator.

    The optimizer merges projections and pushes filters through them, which would repeat a costly array
    expression inside a lambda, a filter or a Python step's argument. It does neither across a generator.
    """
    return spread_struct(df, F.struct(*[column.alias(name) for name, column in columns.items()]), list(columns))


def spread_struct(df: DataFrame, held: Column, names: list[str]) -> DataFrame:
    """The fields of one struct expression as columns, worked out once."""
    return df.select(*[F.col(name) for name in df.columns if name not in names], F.inline(F.array(held)))
