"""Country and state ids from a reference tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.geo import country_name, location_key
from gleaner.operators.shape import geo_table


def _keyed(rows: DataFrame, keys: Column) -> DataFrame:
    return rows.withColumn("_key", F.explode(F.array_distinct(keys))).filter(F.col("_key") != "")


def match_country_state_ids(
    df: DataFrame, tree: DataFrame, state: str = "state", country: str = "country"
) -> DataFrame:
    """Add ``state_id`` and ``country_id``: the country by name or code, then a state inside that country.

    A state found without a country brings its parent along. Equal keys go to the smallest id.
    """
    rows = geo_table(tree)
    name_key, code_key = location_key(F.col("name")), location_key(F.col("code"))
    countries = (
        _keyed(rows.filter(F.col("parent_id").isNull()), F.array(name_key, code_key, location_key(country_name(F.col("code")))))
        .groupBy(F.col("_key").alias("_ckey"))
        .agg(F.min("id").alias("_country"))
    )
    states = _keyed(rows.filter(F.col("parent_id").isNotNull()), F.array(name_key, code_key))
    inside = states.groupBy(F.col("_key").alias("_ikey"), F.col("parent_id").alias("_iparent")).agg(F.min("id").alias("_inside"))
    anywhere = states.groupBy(F.col("_key").alias("_akey")).agg(F.min(F.struct("id", "parent_id")).alias("_anywhere"))

    keyed = df.withColumns(
        {
            "_country_key": location_key(country_name(F.col(country))),
            "_state_key": location_key(F.col(state)),
        }
    )
    joined = (
        keyed.join(countries, F.col("_country_key") == F.col("_ckey"), "left")
        .join(inside, (F.col("_state_key") == F.col("_ikey")) & (F.col("_country") == F.col("_iparent")), "left")
        .join(anywhere, F.col("_state_key") == F.col("_akey"), "left")
    )
    lone = F.col("_country").isNull()
    return joined.withColumns(
        {
            "state_id": F.when(lone, F.col("_anywhere.id")).otherwise(F.col("_inside")),
            "country_id": F.coalesce("_country", "_anywhere.parent_id"),
        }
    ).drop(
        "_country_key", "_state_key", "_ckey", "_country", "_ikey", "_iparent", "_inside", "_akey", "_anywhere"
    )
