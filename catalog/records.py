"""Model output and post queries. Answers are written from events, some of them broken."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalog.common import pick
from catalog.text import RUN_TS
from gleaner import constants as K
from gleaner.functions import records as R
from gleaner.operators import shape
from gleaner.sources import sinks
from gleaner.sources.tables import read_table

ANSWERS = 6


def _responses(spark, d):
    """Model answers in turn: fenced, plain with a list, broken, no object, none, and all kinds of values."""
    e = read_table(spark, d, "events", spread=True)
    title = F.concat(F.lit("Job "), F.col("event_type"), F.lit(" "), F.get_json_object("props", "$.k"))
    answers = F.array(
        F.concat(F.lit('```json\n{"job_title":"'), title, F.lit('","salary_range":null,"city":"Reno"}\n```')),
        F.concat(F.lit('{"job_title":"'), title, F.lit('","perks_and_benefits":["x","'), "event_type", F.lit('",null],"country":"US"}')),
        F.concat(F.lit('{"job_title": '), "props"),
        F.lit('["job_title"]'),
        F.lit(None).cast("string"),
        F.concat(F.lit('{"job_title":"'), title, F.lit('","job_id":'), F.col("event_id").cast("string"), F.lit(',"location":true,"employer":"   "}')),
    )
    return e.select(
        "event_id",
        F.get(answers, (F.col("event_id") % ANSWERS).cast("int")).alias("response"),
        F.repeat(F.concat("event_type", F.lit(" ")), (F.col("event_id") % 40).cast("int")).alias("page_text"),
    )


FIELDS = ["job_title", "job_id", "job_description", "location", "city", "country", "salary_range", "perks_and_benefits", "employer"]


def q_model_record(spark, d):
    return R.parse_model_record(_responses(spark, d)).select("event_id", "parsed", *FIELDS)


SQL_MODEL_RECORD = f"""
with e as (select event_id, event_id % {ANSWERS} as kind, 'Job ' || event_type || ' ' || json_extract_string(props, '$.k') as title, event_type,
  repeat(event_type || ' ', event_id % 40) as page_text from events)
select event_id, kind in (0, 1, 5) as parsed,
  case when kind in (0, 1, 5) then title when kind = 2 then '' else '{K.FAILED_CALL_TITLE}' end as job_title,
  case when kind = 5 then cast(event_id as varchar) else '' end as job_id,
  case when kind in (0, 1, 5) then '' when length(page_text) > 200 then left(page_text, 200) || '...' else page_text end as job_description,
  case when kind = 5 then 'True' else '' end as location, case when kind = 0 then 'Reno' else '' end as city,
  case when kind = 1 then 'US' else '' end as country, '' as salary_range,
  case when kind = 1 then 'x' || chr(10) || event_type || chr(10) || 'None' else '' end as perks_and_benefits,
  case when kind = 5 then '   ' else '' end as employer from e"""


def _stub_model():
    """Stands in for a caller's model: answers with the prompt's size, fails on some prompts."""

    def answer(prompt: str) -> str:
        if "error" in prompt:
            raise ValueError("no answer")
        return '{"job_title": "' + str(len(prompt)) + ' characters"}'

    return answer


def q_model_stub(spark, d):
    rows = _responses(spark, d).select("event_id", F.col("page_text"), F.col("page_text").alias("prompt"))
    return R.parse_model_record(R.extract_with_model(rows, _stub_model)).select("event_id", "job_title", "job_description")


SQL_MODEL_STUB = f"""
with e as (select event_id, repeat(event_type || ' ', event_id % 40) as t from events)
select event_id, case when contains(t, 'error') then '{K.FAILED_CALL_TITLE}' else length(t) || ' characters' end as job_title,
  case when not contains(t, 'error') then '' when length(t) > 200 then left(t, 200) || '...' else t end as job_description from e"""

# --- verbatim model text ------------------------------------------------------------------------

VERBATIM = ['{"description":"A  b\\n\\n\\n c "}', '{"description":null}', '{"description":"  "}', "no json", '{"other":1}', '```json\n{"description":"x"}\n```']


def q_verbatim(spark, d):
    rows = read_table(spark, d, "events", spread=True).select("event_id", "event_type", pick(VERBATIM, F.col("event_id")).alias("response"))
    return rows.select("event_id", R.verbatim_or_rule(F.col("response"), F.col("event_type")).alias("description"))


SQL_VERBATIM = """
select event_id, case event_id % 6 when 0 then 'A b' || chr(10) || chr(10) || 'c' when 1 then null when 4 then null when 5 then 'x' else event_type end as description from events"""

# --- posts --------------------------------------------------------------------------------------


def _records(spark, d):
    """Order rows as job records under both spellings of their fields."""
    o = read_table(spark, d, "orders", spread=True).join(read_table(spark, d, "customer", spread=True), F.col("o_custkey") == F.col("c_custkey"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return o.select(
        "o_orderkey",
        F.when(urgent, F.lit("")).otherwise(F.col("c_name")).alias("employer"),
        F.concat(F.lit("Alt "), "c_name").alias("employerName"),
        F.col("o_orderpriority").alias("jobTitle"),
        F.when(urgent, F.col("o_orderkey").cast("string")).alias("job_id"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit("-9 years")).alias("preferredExperience"),
        F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("soon")).alias("application_deadline"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), F.col("c_nationkey").cast("string"))).otherwise(F.lit("n/a")).alias("category_id"),
        F.concat(F.lit("site-"), F.col("c_nationkey").cast("string")).alias("micrositeId"),
        F.concat(F.lit("https://jobs.example.com/"), F.col("o_orderkey").cast("string"), F.lit("?ref=x")).alias("source_url"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("postedById"),
    )


def q_post_rows(spark, d):
    return R.post_rows(_records(spark, d), RUN_TS).select(
        "id", "employerName", "hideEmployer", "jobTitle", "jobId", "description", F.col("applicationDeadline").cast("string").alias("applicationDeadline"),
        "preferredExperience", "postedById", "channels", "siteId", "isScrapped", "active", F.col("createdAt").cast("string").alias("createdAt"),
        "source_url", "categoryId", "city",
    )


SQL_POST_ROWS = f"""
with r as (select *, sha256('site-' || c_nationkey || '|https://jobs.example.com/' || o_orderkey) as id, o_orderpriority = '1-URGENT' as urgent
  from orders join customer on o_custkey = c_custkey)
select id, case when urgent then 'Alt ' || c_name else c_name end as "employerName", false as "hideEmployer", o_orderpriority as "jobTitle",
  case when urgent then cast(o_orderkey as varchar) else id end as "jobId", '' as description,
  case when o_orderstatus <> 'P' then strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' else '2024-07-01 12:00:00' end as "applicationDeadline",
  c_nationkey as "preferredExperience", case when c_acctbal > 0 then c_mktsegment else '{K.DEFAULT_OWNER}' end as "postedById",
  cast(null as varchar) as channels, 'site-' || c_nationkey as "siteId", true as "isScrapped", true as active, '2024-06-01 12:00:00' as "createdAt",
  'https://jobs.example.com/' || o_orderkey || '?ref=x' as source_url, case when o_orderstatus = 'F' then c_nationkey end as "categoryId", '' as city from r"""


def q_update_rows(spark, d):
    posts = read_table(spark, d, "orders", spread=True).select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit(0).alias("categoryId"), F.col("o_orderdate").cast("timestamp_ntz").alias("updatedAt")
    )
    updates = read_table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").cast("string").alias("id"), F.when(F.col("l_linenumber") == 1, F.lit("none")).otherwise(F.col("l_linenumber").cast("string")).alias("category_id")
    )
    return sinks.apply_category_updates(posts, updates, RUN_TS).withColumn("updatedAt", F.col("updatedAt").cast("string"))


SQL_UPDATE_ROWS = """
with u as (select l_orderkey, max(l_linenumber) as c from lineitem where l_returnflag = 'R' and l_linenumber <> 1 group by l_orderkey)
select cast(o_orderkey as varchar) as id, coalesce(c, 0) as "categoryId", c is not null as was_updated,
  case when c is not null then '2024-06-01 12:00:00' else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as "updatedAt"
from orders left join u on o_orderkey = l_orderkey"""


def q_ensure_columns(spark, d):
    old = read_table(spark, d, "customer", spread=True).select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("employerName"))
    wanted = StructType.fromDDL("id string, employerName string, categoryId int, requiredExperience string")
    new = read_table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").alias("categoryId"))
    return shape.ensure_columns(old, wanted).unionByName(new, allowMissingColumns=True)


SQL_ENSURE_COLUMNS = """
select cast(c_custkey as varchar) as id, c_name as "employerName", cast(null as integer) as "categoryId", cast(null as varchar) as "requiredExperience" from customer
union all select 's' || s_suppkey, null, s_nationkey, null from supplier"""


def q_alias_coalesce(spark, d):
    return shape.alias_coalesce(
        _records(spark, d),
        {"o_orderkey": ["o_orderkey"], "employer": ["employer", "employerName"], "title": ["job_title", "jobTitle"], "owner": ["postedById"], "absent": ["x", "y"]},
    )


SQL_ALIAS_COALESCE = """
select cast(o_orderkey as varchar) as o_orderkey, case when o_orderpriority = '1-URGENT' then 'Alt ' || c_name else c_name end as employer,
  o_orderpriority as title, case when c_acctbal > 0 then c_mktsegment else '' end as owner, '' as absent
from orders join customer on o_custkey = c_custkey"""

_NAMES = ["model_record", "model_stub", "verbatim", "post_rows", "update_rows", "ensure_columns", "alias_coalesce"]
QUERIES = {f"q_{name}": globals()[f"q_{name}"] for name in _NAMES}
ORACLES = {f"q_{name}": globals()[f"SQL_{name.upper()}"] for name in _NAMES}
