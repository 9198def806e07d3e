"""Location queries. Customers get location texts built from their key, so all rows take part."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import pick, pick_sql, quote, sql_list
from gleaner import constants as K
from gleaner.functions import geo as G
from gleaner.operators.geo import match_country_state_ids
from gleaner.sources.tables import read_table

HEADS = [
    "Toronto", "San Diego", "Denver", "Val-d'Or", "Bldg 4, Lively", "Remote - Austin", "Lima", "Greater Sudbury, Lively",
    "Hybrid, Chicago", "Paris", "  Full-time | Halifax ", "Reno / Sparks", "",
]
TAILS = [", ON", ", CA", ", CO, USA", "", ", TX 78701", ", Peru", ", Ontario, Canada P3E 5P9", ", U.S.", " - Nevada", " | new york | US", ", washington dc."]
CITIES = ["", "", "", "Boston", " Montreal, "]
STATES = ["", "", "", "", "", "qc", "Texas", "Bavaria"]
COUNTRIES = ["", "", "", "", "", "", "", "america", "CAN.", "Germany"]


def _customers(spark, d):
    key = F.col("c_custkey")
    return read_table(spark, d, "customer", spread=True).select(
        "c_custkey",
        F.concat(pick(HEADS, key), pick(TAILS, F.floor(key / 13))).alias("location"),
        pick(CITIES, F.floor(key / 3)).alias("city"),
        pick(STATES, F.floor(key / 5)).alias("state"),
        pick(COUNTRIES, F.floor(key / 7)).alias("country"),
    )


_CUSTOMERS_SQL = f"""
  select c_custkey, {pick_sql(HEADS, 'c_custkey')} || {pick_sql(TAILS, 'c_custkey // 13')} as location,
    {pick_sql(CITIES, 'c_custkey // 3')} as city, {pick_sql(STATES, 'c_custkey // 5')} as state,
    {pick_sql(COUNTRIES, 'c_custkey // 7')} as country from customer"""


def _values(table: dict) -> str:
    return "map {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in table.items()) + "}"


def _clean(value: str) -> str:
    tidy = lambda v: rf"trim(regexp_replace({v}, '\s+', ' ', 'g'), ' ,|-')"
    return tidy(rf"regexp_replace({tidy(f'coalesce({value}, {quote('')})')}, '(?i)\b(?:remote|hybrid|onsite|on-site|full[- ]time|part[- ]time)\b', '', 'g')")


# Macros keep the staged SQL readable; DuckDB expands them in place.
def _country(cleaned: str) -> str:
    return f"coalesce((select m from (select {_values(K.COUNTRY_ALIASES)}[trim(lower({cleaned}), '.')] as m)), {cleaned})"


def _state(cleaned: str, country: str) -> str:
    key = f"trim(lower({cleaned}), '.')"
    province, us = f"{_values(G.PROVINCES)}[{key}]", f"{_values(G.US_STATES)}[{key}]"
    return f"case when lower({country}) = 'canada' or {province} is not null then coalesce({province}, {cleaned}) else coalesce({us}, {cleaned}) end"


def _country_of(state: str) -> str:
    key = f"trim(lower({state}), '.')"
    provinces, states = sql_list(sorted(set(G.PROVINCES.values()))), sql_list(sorted(set(G.US_STATES.values())))
    return (
        f"case when {_values(G.PROVINCES)}[{key}] is not null or list_contains({provinces}, {state}) then 'Canada' "
        f"when {_values(G.US_STATES)}[{key}] is not null or list_contains({states}, {state}) then 'United States' else '' end"
    )


def q_location(spark, d):
    return G.standardize_location(_customers(spark, d)).select("c_custkey", "location", "city", "state", "country")


def _hint(column: str, part: int) -> str:
    table = {name: hint[part] for name, hint in K.CITY_HINTS.items()}
    return f"{_values(table)}[lower({column})]"


SQL_LOCATION = f"""
with c as ({_CUSTOMERS_SQL}),
a as (select c_custkey, {_clean('location')} as raw, {_clean('city')} as city, {_clean('state')} as state, {_clean('country')} as k0 from c),
b as (select c_custkey, raw, city, state, {_country('k0')} as country,
  list_filter(list_transform(string_split_regex(regexp_replace(raw, '(?i)\\b[A-Z][0-9][A-Z][ -]?[0-9][A-Z][0-9]\\b|\\b[0-9]{{5}}(?:-[0-9]{{4}})?\\b', '', 'g'),
    '\\s*(?:,|\\||/|•| - )\\s*'), lambda x: {_clean('x')}), lambda x: x <> '') as parts from a),
e as (select *, coalesce(parts[len(parts)], '') as tail from b),
f as (select *, country = '' and {_country('tail')} in ('Canada', 'United States') as takes from e),
g as (select c_custkey, raw, city, state, case when takes then {_country('tail')} else country end as country,
  case when takes then parts[1:len(parts) - 1] else parts end as parts from f),
h as (select *, len(parts) as n, coalesce(parts[len(parts)], '') as lastp from g),
i as (select *, {_state('lastp', 'country')} as possible from h),
j as (select *, n = 1 and state = '' and {_country_of('possible')} <> '' as single from i),
k as (select c_custkey, raw, country,
  case when state = '' and (n >= 2 or single) then possible else state end as state,
  case when city = '' and n >= 2 then case when n > 2 and possible = lastp then parts[n - 1] else parts[1] end
       when city = '' and n = 1 and not single then lastp else city end as city from j),
l as (select c_custkey, raw, country, city, {_state('state', 'country')} as state from k),
m as (select c_custkey, raw, city, state, case when country = '' then {_country_of('state')} else country end as country from l),
o as (select *, city <> '' and (state = '' or country = '') and {_hint('city', 0)} is not null as hinted from m),
p as (select c_custkey, raw, case when hinted then {_hint('city', 0)} else city end as city,
  case when hinted and state = '' then {_hint('city', 1)} else state end as state,
  case when hinted and country = '' then {_hint('city', 2)} else country end as country from o),
q as (select c_custkey, raw, city, state, case when country = '' then {_country_of('state')} else country end as country from p)
select c_custkey, coalesce(nullif(concat_ws(', ', nullif(city, ''), nullif(state, ''), nullif(country, '')), ''), raw) as location, city, state, country from q"""


def q_region_filter(spark, d):
    return _customers(spark, d).select("c_custkey", "location", G.is_canada_us(F.col("location")).alias("kept"))


SQL_REGION_FILTER = f"""
with c as ({_CUSTOMERS_SQL})
select c_custkey, location, len(list_filter({sql_list(K.CANADA_KEYWORDS + K.US_KEYWORDS)}, lambda w: contains(lower(location), w))) > 0
  or len(list_intersect(regexp_extract_all(lower(location), '\\b([a-z]{{2}})\\b', 1), {sql_list(list(K.US_STATE_CODES))})) > 0 as kept from c"""

SPELLINGS = ["CA", "usa", " United States of America ", "Canada.", "u.s.", "Peru", "remote America", ""]


def q_country_name(spark, d):
    rows = read_table(spark, d, "customer", spread=True).select("c_custkey", pick(SPELLINGS, F.col("c_custkey")).alias("country"))
    return rows.select("c_custkey", G.country_name(F.col("country")).alias("country"))


SQL_COUNTRY_NAME = f"""
with c as (select c_custkey, {_clean(pick_sql(SPELLINGS, 'c_custkey'))} as v from customer)
select c_custkey, {_country('v')} as country from c"""

STATE_SPELLINGS = ["on", "QC.", "B.C.", "ca", "washington dc", "Bavaria", "pei", "  new   york", "à"]


def q_state_name(spark, d):
    rows = read_table(spark, d, "customer", spread=True).select(
        "c_custkey",
        pick(STATE_SPELLINGS, F.col("c_custkey")).alias("state"),
        pick(["", "Canada", "United States", "Peru"], F.col("c_nationkey")).alias("country"),
    )
    return rows.select("c_custkey", G.state_name(F.col("state"), F.col("country")).alias("state"))


SQL_STATE_NAME = f"""
with c as (select c_custkey, {_clean(pick_sql(STATE_SPELLINGS, 'c_custkey'))} as v, {pick_sql(['', 'Canada', 'United States', 'Peru'], 'c_nationkey')} as k from customer)
select c_custkey, {_state('v', 'k')} as state from c"""


def q_geo_ids(spark, d):
    region, nation = read_table(spark, d, "region"), read_table(spark, d, "nation")
    tree = region.select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"),
        F.left("r_name", F.lit(2)).alias("code"), F.lit(None).cast("string").alias("parent_id"),
    ).unionByName(
        nation.select(
            F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"),
            F.concat(F.lit("N-"), (F.col("n_nationkey") % 7).cast("string")).alias("code"),
            F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"),
        )
    )
    # Every second customer names the state by code; the country may be a name, a code, wrong or absent.
    customers = read_table(spark, d, "customer", spread=True).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    customers = customers.join(region, F.col("r_regionkey") == F.when(F.col("c_acctbal") > 2000, F.col("n_regionkey")).otherwise((F.col("n_regionkey") + 1) % 5))
    rows = customers.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("n "), (F.col("n_nationkey") % 7).cast("string"))).alias("state"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("")).when(F.col("c_mktsegment") == "BUILDING", F.left("r_name", F.lit(2))).otherwise(F.col("r_name")).alias("country"),
    )
    return match_country_state_ids(rows, tree)


_KEY = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


def _k(value: str) -> str:
    cleaned = f"lower({value})"
    return f"regexp_replace(coalesce({_values(K.COUNTRY_ALIASES)}[{cleaned}], {cleaned}), '[^A-Za-z0-9]+', '', 'g')"


SQL_GEO_IDS = f"""
with c as (select c_custkey,
    case when c_custkey % 2 = 0 then n_name else 'n ' || (n_nationkey % 7) end as state,
    case when c_mktsegment = 'HOUSEHOLD' then '' when c_mktsegment = 'BUILDING' then left(r_name, 2) else r_name end as country
  from customer join nation on c_nationkey = n_nationkey
  join region on r_regionkey = case when c_acctbal > 2000 then n_regionkey else (n_regionkey + 1) % 5 end),
ck as (select min('r' || r_regionkey) as id, key from (
    select r_regionkey, lower({_k('r_name')}) as key from region union select r_regionkey, lower({_k('left(r_name, 2)')}) from region) s group by key),
sk as (select 'n' || n_nationkey as id, 'r' || n_regionkey as parent, lower({_k('n_name')}) as key from nation
  union select 'n' || n_nationkey, 'r' || n_regionkey, 'n' || (n_nationkey % 7) from nation),
j as (select c.*, ck.id as cid, {_KEY.format('c.state')} as skey from c left join ck on ck.key = lower({_k('c.country')}) and c.country <> '')
select c_custkey, state, country,
  case when cid is not null then (select min(id) from sk where sk.key = skey and sk.parent = cid) else (select min(id) from sk where sk.key = skey) end as state_id,
  coalesce(cid, (select arg_min(parent, id) from sk where sk.key = skey)) as country_id from j"""

_NAMES = ["location", "region_filter", "country_name", "state_name", "geo_ids"]
QUERIES = {f"q_{name}": globals()[f"q_{name}"] for name in _NAMES}
ORACLES = {f"q_{name}": globals()[f"SQL_{name.upper()}"] for name in _NAMES}
