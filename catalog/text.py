"""Text, number and date queries over whole documents, conversations and events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.common import WS, normalize_sql, pick, pick_sql, strip_sql
from gleaner import constants as K
from gleaner.functions import text as T
from gleaner.sources.tables import read_table

RUN_TS = datetime(2024, 6, 1, 12, 0, 0)


def _documents(spark, d):
    return read_table(spark, d, "documents", spread=True).select("doc_id", "text")


def q_normalize_space(spark, d):
    spaced = F.replace(F.replace("text", F.lit(" of "), F.lit(" of\t ")), F.lit(". "), F.lit(".  "))
    return _documents(spark, d).select("doc_id", T.normalize_space(spaced).alias("text"))


SQL_NORMALIZE_SPACE = f"""
select doc_id, {normalize_sql("replace(replace(text, ' of ', chr(160) || 'of' || chr(9) || ' '), '. ', '. ' || chr(8195))")} as text from documents"""


def q_truncate(spark, d):
    c = F.col("text")
    cut = {n: T.truncate_text(c, n) for n in (K.JOB_TEXT_LIMIT, K.COMPANY_TEXT_LIMIT, K.EXCERPT_LIMIT)}
    shown = T.display_text(F.when(F.length(c) % 5 == 0, F.lit("")).otherwise(c))
    columns = [F.sha2(v, 256).alias(f"cut_{n}") for n, v in cut.items()]
    return _documents(spark, d).select("doc_id", *columns, shown.alias("shown"))


def _cut(n: int) -> str:
    return f"case when length(text) > {n} then left(text, {n}) || '...' else text end"


SQL_TRUNCATE = f"""
select doc_id, {", ".join(f"sha256({_cut(n)}) as cut_{n}" for n in (K.JOB_TEXT_LIMIT, K.COMPANY_TEXT_LIMIT, K.EXCERPT_LIMIT))},
  case when length(text) % 5 = 0 or text = '' then 'N/A' when length(text) > 100 then left(text, 100) || '...' else text end as shown
from documents"""

FENCES = ["", "```json\n", "```\n", "  ```json"]
TAILS = ["", "\n```", "```  ", "\n``` x"]


def q_code_fence(spark, d):
    events = read_table(spark, d, "events", spread=True)
    raw = F.concat(pick(FENCES, F.col("event_id")), F.col("props"), pick(TAILS, F.floor(F.col("event_id") / 4)))
    return events.select(
        "event_id",
        T.strip_code_fence(raw).alias("any_fence"),
        T.strip_space(T.strip_code_fence(raw, any_fence=False)).alias("json_fence"),
    )


_FENCED = f"trim({pick_sql(FENCES, 'event_id')} || props || {pick_sql(TAILS, 'event_id // 4')}, ' ' || chr(10))".replace("\n", "' || chr(10) || '")


def _unfence(opening: str) -> str:
    body = f"case when starts_with(t, '```json') then substr(t, 8) {opening} else t end"
    return f"trim(case when ends_with({body}, '```') then left({body}, length({body}) - 3) else {body} end, ' ' || chr(10))"


SQL_CODE_FENCE = f"""
with s as (select event_id, {_FENCED} as t from events)
select event_id, {_unfence("when starts_with(t, '```') then substr(t, 4)")} as any_fence, {_unfence("")} as json_fence from s"""


def q_first_int(spark, d):
    events = read_table(spark, d, "events", spread=True)
    texts = F.array(F.lit("none"), F.concat(F.col("user_id").cast("string"), F.lit("-9 years")), F.concat(F.lit("about "), F.col("props")), F.lit(""))
    years = F.get(texts, (F.col("event_id") % 4).cast("int"))
    return events.select("event_id", T.first_int(years).alias("years"))


SQL_FIRST_INT = """
with s as (select event_id, ['none', user_id || '-9 years', 'about ' || props, ''][(event_id % 4) + 1] as t from events)
select event_id, coalesce(try_cast(regexp_extract(t, '[0-9]+') as integer), 0) as years from s"""

LAYOUTS = [("yyyy-MM-dd", "%Y-%m-%d"), ("MMMM d, yyyy", "%B %-d, %Y"), ("MM/dd/yyyy", "%m/%d/%Y"), ("d MMM yyyy", "%-d %b %Y")]


def q_deadline(spark, d):
    orders = read_table(spark, d, "orders", spread=True)
    stamp = F.col("o_orderdate")
    spelled = F.array(*[F.date_format(stamp, spark_layout) for spark_layout, _ in LAYOUTS], F.lit("open until filled"))
    text = F.get(spelled, (F.col("o_orderkey") % 5).cast("int"))
    return orders.select("o_orderkey", T.deadline_or_default(text, RUN_TS).cast("string").alias("deadline"))


SQL_DEADLINE = """
select o_orderkey, case when o_orderkey % 5 = 4 then '2024-07-01 12:00:00' else strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' end as deadline
from orders"""


def q_clamp(spark, d):
    lines = read_table(spark, d, "lineitem")
    asked = F.when(F.col("l_returnflag") != "N", F.col("l_linenumber") - 2).cast("int")
    return lines.groupBy(asked.alias("asked")).agg(F.count(F.lit(1)).alias("n")).withColumn("jobs", T.clamp(F.col("asked"), 1, K.API_MAX_JOBS))


SQL_CLAMP = """
with s as (select cast(case when l_returnflag <> 'N' then l_linenumber - 2 end as integer) as asked from lineitem)
select asked, count(*) as n, cast(greatest(1, least(coalesce(asked, 5), 5)) as integer) as jobs from s group by asked"""


def q_dedupe_ci(spark, d):
    docs = _documents(spark, d)
    lines = F.split("text", "\n")
    doubled = F.concat(lines, F.transform(lines, lambda x: F.lower(x)), F.transform(lines, lambda x: F.concat(x, F.lit("!"))), lines)
    kept = T.dedupe_ci(doubled)
    return docs.select("doc_id", F.posexplode(kept).alias("pos", "line")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.sha2("line", 256).alias("line"))


SQL_DEDUPE_CI = """
with s as (select doc_id, string_split(text, chr(10)) as ls from documents),
t as (select doc_id, list_concat(list_concat(list_concat(ls, list_transform(ls, lambda x: lower(x))), list_transform(ls, lambda x: x || '!')), ls) as vs from s),
r as (select doc_id, i, vs[i] as line from t, unnest(range(1, len(vs) + 1)) as u(i)),
f as (select doc_id, arg_min(line, i) as line, min(i) as i from r group by doc_id, lower(line))
select doc_id, row_number() over (partition by doc_id order by i) - 1 as pos, sha256(line) as line from f"""


def q_blank_runs(spark, d):
    spread = F.replace(F.replace("text", F.lit("\n"), F.lit(" \n\t\n\n ")), F.lit(", "), F.lit(" ,  "))
    return _documents(spark, d).select("doc_id", T.collapse_blank_lines(spread).alias("text"))


SQL_BLANK_RUNS = f"""
with s as (select doc_id, string_split(replace(replace(text, chr(10), ' ' || chr(10) || chr(9) || chr(10) || chr(10) || ' '), ', ', ' ,' || chr(160) || ' '), chr(10)) as ls from documents),
r as (select doc_id, i, {strip_sql("regexp_replace(replace(ls[i], chr(160), ' '), '[ \t]+', ' ', 'g')")} as line from s, unnest(range(1, len(ls) + 1)) as u(i)),
k as (select *, lag(line) over (partition by doc_id order by i) as before from r)
select doc_id, {strip_sql("string_agg(line, chr(10) order by i)")} as text from k
where line <> '' or coalesce(before, 'x') <> '' group by doc_id"""


def q_mojibake(spark, d):
    a = "Â"
    broken = F.replace(F.replace("text", F.lit(" of "), F.lit(f" {a} of{a} ")), F.lit(".\n"), F.lit(f".{a}\n{a}&"))
    return _documents(spark, d).select("doc_id", T.fix_mojibake(broken).alias("text"))


SQL_MOJIBAKE = rf"""
with s as (select doc_id, replace(replace(text, ' of ', ' ' || chr(194) || chr(160) || 'of' || chr(194) || ' '), '.' || chr(10), '.' || chr(194) || chr(10) || chr(194) || '&') as t from documents)
select doc_id, regexp_replace(replace(replace(t, chr(194) || chr(160), chr(160)), chr(194) || ' ', ' '), chr(194) || '({WS}|<|&)', '\1', 'g') as text from s"""


def q_compact_map(spark, d):
    customer = read_table(spark, d, "customer", spread=True)
    fields = F.create_map(
        F.lit("name"), F.col("c_name"),
        F.lit("segment"), pick(["", " ", None, " ", "x"], F.col("c_custkey")),
        F.lit("nation"), F.when(F.col("c_nationkey") < 12, F.col("c_nationkey").cast("string")),
    )
    kept = T.drop_blank_fields(fields)
    joined = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return customer.select("c_custkey", F.size(kept).cast("bigint").alias("n"), joined.alias("fields"))


SQL_COMPACT_MAP = """
with s as (select c_custkey, ['name=' || c_name, case when c_custkey % 5 = 4 then 'segment=x' end,
  case when c_nationkey < 12 then 'nation=' || c_nationkey end] as fs from customer)
select c_custkey, len(list_filter(fs, lambda f: f is not null)) as n, array_to_string(list_filter(fs, lambda f: f is not null), ';') as fields from s"""

_NAMES = [
    "normalize_space", "truncate", "code_fence", "first_int", "deadline", "clamp", "dedupe_ci", "blank_runs", "mojibake",
    "compact_map",
]
QUERIES = {f"q_{name}": globals()[f"q_{name}"] for name in _NAMES}
ORACLES = {f"q_{name}": globals()[f"SQL_{name.upper()}"] for name in _NAMES}
