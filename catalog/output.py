"""Report and response queries over customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import pick, pick_sql
from gleaner import constants as K
from gleaner.sources import sinks
from gleaner.sources.tables import read_table

BLANKS = ["", " ", "Reno", "Ottawa, ON"]


def _records(spark, d):
    return read_table(spark, d, "customer", spread=True).select(
        F.col("c_custkey").cast("string").alias("job_id"),
        F.col("c_name").alias("employer"),
        F.col("c_mktsegment").alias("job_title"),
        pick(BLANKS, F.col("c_custkey")).alias("location"),
        F.when(F.col("c_acctbal") > 0, F.lit("x")).alias("html_content"),
        F.when(F.col("c_nationkey") > 12, F.col("c_nationkey").cast("string")).alias("state"),
    )


def q_compact_json(spark, d):
    return sinks.to_response_json(_records(spark, d))


SQL_COMPACT_JSON = f"""
select '{{"job_id":"' || c_custkey || '","employer":"' || c_name || '","job_title":"' || c_mktsegment || '"'
  || case when trim({pick_sql(BLANKS, 'c_custkey')}) <> '' then ',"location":"' || {pick_sql(BLANKS, 'c_custkey')} || '"' else '' end
  || case when c_nationkey > 12 then ',"state":"' || c_nationkey || '"' else '' end || '}}' as json from customer"""


def q_csv_projection(spark, d):
    return sinks.csv_projection(_records(spark, d))


_FILLED = {
    "employer": "c_name", "job_title": "c_mktsegment", "job_id": "cast(c_custkey as varchar)", "location": pick_sql(BLANKS, "c_custkey"),
    "state": "case when c_nationkey > 12 then cast(c_nationkey as varchar) else '' end",
}
SQL_CSV_PROJECTION = "select " + ", ".join(f"""{_FILLED.get(name, "''")} as "{heading}\"""" for name, heading in K.CSV_HEADINGS.items()) + " from customer"


def q_sort_page(spark, d):
    return sinks.page_of(_records(spark, d), 3, "job_title", descending=True, tie="job_id").select("job_id", "job_title", "employer", "total_pages")


SQL_SORT_PAGE = """
select cast(c_custkey as varchar) as job_id, c_mktsegment as job_title, c_name as employer, cast(ceil((select count(*) from customer) / 10.0) as bigint) as total_pages
from customer order by c_mktsegment desc, cast(c_custkey as varchar) limit 10 offset 20"""


def q_sort_deep(spark, d):
    """Every row with its place in the sorted report, as deep pages use it."""
    from gleaner.operators.ranking import global_position

    rows = _records(spark, d)
    return global_position(rows, [sinks.sort_key("location").asc(), F.col("job_id")], "place").select("job_id", "location", F.col("place").cast("bigint").alias("place"))


SQL_SORT_DEEP = f"""
with c as (select cast(c_custkey as varchar) as job_id, {pick_sql(BLANKS, 'c_custkey')} as location from customer)
select *, row_number() over (order by location, job_id) as place from c"""

_NAMES = ["compact_json", "csv_projection", "sort_page", "sort_deep"]
QUERIES = {f"q_{name}": globals()[f"q_{name}"] for name in _NAMES}
ORACLES = {f"q_{name}": globals()[f"SQL_{name.upper()}"] for name in _NAMES}
