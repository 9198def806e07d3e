"""Location expressions: names, keys and the standardised location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.staging import settled
from gleaner.functions.text import SPACE, blank_to_null, literal_map

CANADA, UNITED_STATES = "Canada", "United States"


def _with_names(codes: dict[str, str], aliases: dict[str, str]) -> dict[str, str]:
    return {**codes, **{name.lower(): name for name in codes.values()}, **aliases}


PROVINCES = _with_names(K.PROVINCE_CODES, K.PROVINCE_ALIASES)
US_STATES = _with_names(K.US_STATE_CODES, K.US_STATE_ALIASES)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(table), key)


def clean_location_part(value: Column) -> Column:
    """Collapse blanks, cut edge marks and drop work-mode words."""

    def tidy(text: Column) -> Column:
        return F.btrim(F.regexp_replace(text, rf"(?U){SPACE}+", " "), F.lit(" ,|-"))

    text = tidy(F.coalesce(value, F.lit("")))
    return tidy(F.regexp_replace(text, f"(?iU){K.WORK_MODE_PATTERN}", ""))


def _name_key(value: Column) -> Column:
    return F.btrim(F.lower(value), F.lit("."))


def _alias_country(cleaned: Column) -> Column:
    return F.coalesce(_lookup(K.COUNTRY_ALIASES, _name_key(cleaned)), cleaned)


def country_name(value: Column) -> Column:
    return _alias_country(clean_location_part(value))


def state_name(value: Column, country: Column) -> Column:
    """Full province or state name; unknown text is returned cleaned."""
    cleaned = clean_location_part(value)
    key = _name_key(cleaned)
    country_key = F.lower(F.coalesce(country, F.lit("")))
    province, us_state = _lookup(PROVINCES, key), _lookup(US_STATES, key)
    return (
        F.when((country_key == CANADA.lower()) | province.isNotNull(), F.coalesce(province, cleaned))
        .otherwise(F.coalesce(us_state, cleaned))
    )


def country_of_state(value: Column) -> Column:
    """Canada or United States by key or full name, else ''."""
    key = _name_key(clean_location_part(value))
    return (
        F.when(_lookup(PROVINCES, key).isNotNull() | value.isin(list(K.PROVINCE_CODES.values())), F.lit(CANADA))
        .when(_lookup(US_STATES, key).isNotNull() | value.isin(list(K.US_STATE_CODES.values())), F.lit(UNITED_STATES))
        .otherwise(F.lit(""))
    )


def city_hint(city: Column) -> Column:
    """Array of city, state and country of a well-known city, else NULL."""
    return F.try_element_at(literal_map(K.CITY_HINTS), F.lower(clean_location_part(city)))


def location_key(value: Column) -> Column:
    """Comparison key of a place name: a-z and digits only."""
    cleaned = F.lower(clean_location_part(value))
    aliased = F.coalesce(_lookup(K.COUNTRY_ALIASES, F.btrim(cleaned, F.lit("."))), cleaned)
    return F.regexp_replace(F.lower(aliased), "[^a-z0-9]+", "")


def strip_postal(value: Column) -> Column:
    return F.regexp_replace(value, f"(?iU){K.POSTAL_PATTERN}", "")


def location_parts(value: Column) -> Column:
    """Cleaned non-empty pieces of a location without its postal code."""
    pieces = F.split(strip_postal(value), rf"(?U){SPACE}*(?:,|\||/|\u2022| - ){SPACE}*")
    return F.filter(F.transform(pieces, clean_location_part), lambda part: part != "")


def is_canada_us(location: Column, mode: str = "substring") -> Column:
    """Does the text name Canada or the United States? ``mode='word'`` asks for whole words."""
    text = F.lower(F.coalesce(location, F.lit("")))
    words = [word.replace(".", r"\.") for word in K.CANADA_KEYWORDS + K.US_KEYWORDS]
    keyword = "|".join(words)
    if mode == "word":
        keyword = rf"(?<!\w)(?:{keyword})(?!\w)"
    codes = "|".join(K.US_STATE_CODES)
    return text.rlike(keyword) | text.rlike(rf"(?U)\b(?:{codes})\b")


def standardize_location(
    df: DataFrame,
    location: str = "location",
    city: str = "city",
    state: str = "state",
    country: str = "country",
) -> DataFrame:
    """Rewrite the four columns to city, full state name, country and the joined location.

    Each step is one projection, so later steps read the values earlier steps settled.
    """

    def given(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit("")

    cleaned = df.withColumns(
        {
            "_raw": clean_location_part(given(location)),
            "_city": clean_location_part(given(city)),
            "_state": clean_location_part(F.coalesce(blank_to_null(given(state)), given("province"))),
            "_country": country_name(given(country)),
        }
    ).withColumn("_parts", location_parts(F.col("_raw")))

    # The last part may be the country.
    tail = F.coalesce(country_name(F.try_element_at("_parts", F.lit(-1))), F.lit(""))
    takes_tail = (F.col("_country") == "") & tail.isin(CANADA, UNITED_STATES)
    countries = cleaned.withColumn("_takes", takes_tail).withColumns(
        {
            "_country": F.when(F.col("_takes"), tail).otherwise(F.col("_country")),
            "_parts": F.when(F.col("_takes"), F.slice("_parts", F.lit(1), F.size("_parts") - 1)).otherwise(F.col("_parts")),
        }
    )

    # The last remaining part may be the state; the city stands first, or before the state.
    many, single = F.size("_parts") >= 2, F.size("_parts") == 1
    end = F.try_element_at("_parts", F.lit(-1))
    known = countries.withColumn("_possible", state_name(end, F.col("_country")))
    city_of_many = F.when(
        (F.size("_parts") > 2) & (F.col("_possible") == end), F.try_element_at("_parts", F.lit(-2))
    ).otherwise(F.try_element_at("_parts", F.lit(1)))
    single_is_state = single & (country_of_state(F.col("_possible")) != "") & (F.col("_state") == "")
    placed = known.withColumn("_single_state", single_is_state).withColumns(
        {
            "_state": F.when((F.col("_state") == "") & (many | F.col("_single_state")), F.col("_possible")).otherwise(
                F.col("_state")
            ),
            "_city": F.when((F.col("_city") == "") & many, city_of_many)
            .when((F.col("_city") == "") & single & ~F.col("_single_state"), end)
            .otherwise(F.col("_city")),
        }
    )

    def fill_country(source: Column) -> Column:
        return F.when(F.col("_country") == "", country_of_state(source)).otherwise(F.col("_country"))

    named = placed.withColumn("_state", state_name(F.col("_state"), F.col("_country"))).withColumn(
        "_country", fill_country(F.col("_state"))
    )
    gap = (F.col("_city") != "") & ((F.col("_state") == "") | (F.col("_country") == ""))
    hinted = named.withColumn("_hint", F.when(gap, city_hint(F.col("_city")))).withColumns(
        {
            "_city": F.coalesce(F.get("_hint", F.lit(0)), "_city"),
            "_state": F.coalesce(blank_to_null(F.col("_state")), F.get("_hint", F.lit(1)), F.lit("")),
            "_country": F.coalesce(blank_to_null(F.col("_country")), F.get("_hint", F.lit(2)), F.lit("")),
        }
    )
    final = hinted.withColumn("_country", fill_country(F.col("_state")))
    joined = F.concat_ws(", ", *[blank_to_null(F.col(name)) for name in ("_city", "_state", "_country")])
    helpers = ["_raw", "_city", "_state", "_country", "_parts", "_takes", "_possible", "_single_state", "_hint"]
    # Settled, since a filter on the result would otherwise be rewritten in terms of every step above.
    return settled(
        final,
        {
            city: F.col("_city"),
            state: F.col("_state"),
            country: F.col("_country"),
            location: F.coalesce(blank_to_null(joined), F.col("_raw")),
        },
    ).drop(*helpers)
