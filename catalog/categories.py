"""Category queries. The tree is region and nation; job texts come from part."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import pick, pick_sql, sql_list
from gleaner import constants as K
from gleaner.functions import taxonomy as X
from gleaner.operators import taxonomy as T
from gleaner.plans.classify import classify_with_model
from gleaner.sources.tables import read_table


def _tree(spark, d):
    """Regions as parents, nations as children; one nation is called Other, some are switched off."""
    region, nation = read_table(spark, d, "region"), read_table(spark, d, "nation")
    parents = region.select(
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("categoryId"), F.col("r_name").alias("title"),
        F.lit("").alias("parentId"), F.lit("yes").alias("isActive"),
    )
    children = nation.select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")),
        F.when(F.col("n_nationkey") == 7, F.lit("Other")).otherwise(F.col("n_name")),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")),
        F.when(F.col("n_name").like("%3"), F.lit(" No ")).otherwise("1"),
    )
    return parents.union(children)


_TREE_SQL = """
  select 'R' || r_regionkey as id, r_name as name, '' as parent_id, true as active from region
  union all select 'N' || n_nationkey, case when n_nationkey = 7 then 'Other' else n_name end,
    'R' || n_regionkey, not (n_name like '%3') from nation"""


def q_category_parent(spark, d):
    return T.category_parent_name(_tree(spark, d))


SQL_CATEGORY_PARENT = f"""
with t as ({_TREE_SQL})
select t.id, t.name, t.parent_id, coalesce(p.name, '') as parent_name from t left join t p on p.id = t.parent_id"""


def q_selectable_categories(spark, d):
    return T.selectable_categories(_tree(spark, d)).select("id", "name", "parent_id")


SQL_SELECTABLE_CATEGORIES = f"""
with t as ({_TREE_SQL}) select id, name, parent_id from t where active and parent_id <> ''"""


def q_rank_categories(spark, d):
    return T.rank_categories(_tree(spark, d)).select("id", "name", F.col("rank").cast("bigint").alias("rank"))


SQL_RANK_CATEGORIES = f"""
with t as ({_TREE_SQL})
select id, name, row_number() over (order by lower(name) in ('other', 'others'), lower(name), id) as rank from t where active and parent_id <> ''"""


def q_category_prompt(spark, d):
    return T.category_prompt(_tree(spark, d))


SQL_CATEGORY_PROMPT = f"""
with t as ({_TREE_SQL}),
l as (select '- id: ' || t.id || '; name: ' || t.name || case when p.name <> '' then '; parent: ' || p.name else '' end as line,
  lower(t.name) = 'other' as o, lower(t.name) as n, t.id from t left join t p on p.id = t.parent_id where t.active and t.parent_id <> '')
select string_agg(line, chr(10) order by o, n, id) || chr(10) || chr(10) || '{K.OTHER_CATEGORY_NOTE}' as prompt from l"""

# --- jobs from part -----------------------------------------------------------------------------


def _taxonomy(spark, d):
    """The distinct second words of the part names under one parent, with Other and Test."""
    part = read_table(spark, d, "part", spread=True)
    words = part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")).filter("name <> ''").distinct()
    children = words.select(F.concat(F.lit("c-"), "name").alias("id"), F.initcap("name").alias("name"), F.lit("root").alias("parent_id"))
    fixed = read_table(spark, d, "region").select(
        pick(["root", "c-other", "c-test", "c-gone", "c-void"], F.col("r_regionkey")).alias("id"),
        pick(["Parts", "Other", "Test", "Small", "Red"], F.col("r_regionkey")).alias("name"),
        pick(["", "root", "root", "nowhere", "nowhere"], F.col("r_regionkey")).alias("parent_id"),
    )
    return children.unionByName(fixed)


_TAXONOMY_SQL = """
  select 'c-' || w as id, upper(w[1]) || lower(w[2:]) as name, 'root' as parent_id from (select distinct split_part(p_name, ' ', 2) as w from part) s where w <> ''
  union all select ['root', 'c-other', 'c-test', 'c-gone', 'c-void'][r_regionkey + 1], ['Parts', 'Other', 'Test', 'Small', 'Red'][r_regionkey + 1],
    ['', 'root', 'root', 'nowhere', 'nowhere'][r_regionkey + 1] from region"""
_SELECTABLE_SQL = f"""select *, row_number() over (order by lower(name) in ('other', 'others'), lower(name), id) as rk from ({_TAXONOMY_SQL}) t where parent_id <> ''"""

TITLES = ["test job", "Cook", "demo sample", "Senior", "job title", ""]


def _jobs(spark, d):
    part = read_table(spark, d, "part", spread=True)
    size = F.col("p_size") % 4
    return part.select(
        "p_partkey",
        pick(TITLES, F.col("p_partkey")).alias("job_title"),
        F.when(F.col("p_type") == "ECONOMY", F.lit("")).otherwise(F.col("p_name")).alias("job_description"),
        F.when(size == 1, F.lit("n/a")).otherwise(F.lit("")).alias("required_experience"),
        F.when(size == 0, F.concat(F.lit(" C-"), F.split_part("p_name", F.lit(" "), F.lit(2)))).when(size == 1, F.lit("root")).otherwise("").alias("category_id"),
        F.when(size == 2, F.upper(F.split_part("p_name", F.lit(" "), F.lit(2)))).when(size == 3, F.lit("Parts")).otherwise("").alias("category_name"),
    )


_JOBS_SQL = f"""
  select p_partkey, {pick_sql(TITLES, 'p_partkey')} as job_title, case when p_type = 'ECONOMY' then '' else p_name end as job_description,
    case when p_size % 4 = 1 then 'n/a' else '' end as required_experience,
    case p_size % 4 when 0 then ' C-' || split_part(p_name, ' ', 2) when 1 then 'root' else '' end as category_id,
    case p_size % 4 when 2 then upper(split_part(p_name, ' ', 2)) when 3 then 'Parts' else '' end as category_name from part"""
_TEXT = "lower(job_title || ' ' || job_description || '   ' || required_experience || '  ')"


def q_low_info(spark, d):
    jobs = _jobs(spark, d)
    return jobs.select("p_partkey", X.is_low_information(X.job_text(jobs.columns)).alias("low"))


_LOW = f"""(len(tokens) between 1 and 8 and len(list_filter(tokens, lambda t: not list_contains({sql_list(K.NOISE_TOKENS)}, t))) = 0)
  or (len(telling) between 1 and 4 and len(list_filter(telling, lambda t: not list_contains({sql_list(K.NOISE_TOKENS)}, t))) = 0)"""
_LOW_SQL = f"""
  select p_partkey, {_LOW} as low from (select p_partkey, tokens, list_filter(tokens, lambda t: not list_contains({sql_list(K.FILLER_TOKENS)}, t)) as telling
    from (select p_partkey, regexp_extract_all({_TEXT}, '[a-z0-9]+') as tokens from ({_JOBS_SQL}) j) a) b"""
SQL_LOW_INFO = _LOW_SQL


def q_job_prompt(spark, d):
    jobs = _jobs(spark, d)
    return jobs.select("p_partkey", X.job_prompt(jobs.columns).alias("prompt"))


SQL_JOB_PROMPT = f"""
select p_partkey, concat_ws(chr(10), case when job_title <> '' then 'Job title: ' || job_title end,
  case when job_description <> '' then 'Description: ' || job_description end,
  case when required_experience <> '' then 'Required experience: ' || required_experience end) as prompt from ({_JOBS_SQL}) j"""


def q_category_exact(spark, d):
    selectable = T.selectable_categories(_taxonomy(spark, d))
    return T.match_category_exact(_jobs(spark, d), selectable).select("p_partkey", F.col("exact.id").alias("exact_id"))


_EXACT_SQL = f"""
  select p_partkey, arg_min(s.id, s.rk) as exact_id from ({_JOBS_SQL}) j left join ({_SELECTABLE_SQL}) s
    on (trim(j.category_id) <> '' and lower(trim(j.category_id)) = lower(s.id)) or (trim(j.category_name) <> '' and lower(trim(j.category_name)) = lower(s.name))
  group by p_partkey"""
SQL_CATEGORY_EXACT = _EXACT_SQL


def q_category_mention(spark, d):
    jobs = _jobs(spark, d)
    selectable = T.selectable_categories(_taxonomy(spark, d))
    found = T.match_category_mention(jobs, selectable, X.job_text(jobs.columns))
    return found.select("p_partkey", F.col("mentioned.id").alias("mentioned_id"))


_MENTION_SQL = f"""
  select p_partkey, arg_min(s.id, s.rk) as mentioned_id from ({_JOBS_SQL}) j left join ({_SELECTABLE_SQL}) s on contains({_TEXT}, lower(s.name))
  group by p_partkey"""
SQL_CATEGORY_MENTION = _MENTION_SQL


def q_mention_many_names(spark, d):
    """Part and supplier numbers of all order lines are names, tens of thousands of them; orders name a pair, which holds others."""
    names = read_table(spark, d, "lineitem").select(F.concat_ws("-", "l_partkey", "l_suppkey").alias("name")).distinct()
    selectable = T.selectable_categories(names.select(F.concat(F.lit("c"), "name").alias("id"), "name", F.lit("lines").alias("parent_id"), F.lit("1").alias("active")))
    orders = read_table(spark, d, "orders", spread=True)
    jobs = orders.select("o_orderkey", F.format_string("Fits part %d-%d of the list", "o_custkey", F.col("o_orderkey") % 97).alias("job_title"))
    found = T.match_category_mention(jobs, selectable, X.job_text(jobs.columns))
    return found.select("o_orderkey", F.col("mentioned.name").alias("named"))


# Every pair that an order's pair contains: an end of its first number with a beginning of its second.
SQL_MENTION_MANY_NAMES = """
with names as (select distinct l_partkey || '-' || l_suppkey as name from lineitem),
t as (select o_orderkey, cast(o_custkey as varchar) as a, cast(o_orderkey % 97 as varchar) as b from orders),
inside as (select o_orderkey, substr(a, i) || '-' || substr(b, 1, j) as name from t, unnest(range(1, length(a) + 1)) x(i), unnest(range(1, length(b) + 1)) y(j))
select t.o_orderkey, min(n.name) as named from t left join (select * from inside join names using (name)) n on n.o_orderkey = t.o_orderkey group by t.o_orderkey"""


def q_assign_category(spark, d):
    return T.assign_category(_jobs(spark, d), _taxonomy(spark, d)).select("p_partkey", "category_id", "category_name")


_ASSIGN_SQL = f"""
  select l.p_partkey, case when low then 'c-test' else coalesce(exact_id, mentioned_id, 'c-other') end as category_id
  from ({_LOW_SQL}) l join ({_EXACT_SQL}) e on l.p_partkey = e.p_partkey join ({_MENTION_SQL}) m on l.p_partkey = m.p_partkey"""
SQL_ASSIGN_CATEGORY = f"""
select a.p_partkey, a.category_id, s.name as category_name from ({_ASSIGN_SQL}) a join ({_SELECTABLE_SQL}) s on s.id = a.category_id"""


def _posts(spark, d):
    return _jobs(spark, d).select(
        F.concat(F.lit("post-"), F.col("p_partkey").cast("string")).alias("id"), F.col("job_title").alias("jobTitle"),
        F.col("job_description").alias("description"), F.col("required_experience").alias("requiredExperience"),
    )


def q_classify_posts(spark, d):
    return T.classify_posts(_posts(spark, d), _taxonomy(spark, d))


SQL_CLASSIFY_POSTS = f"""
select 'post-' || l.p_partkey as id, s.id as category_id, s.name as category_name
from ({_LOW_SQL}) l join ({_MENTION_SQL}) m on l.p_partkey = m.p_partkey
join ({_SELECTABLE_SQL}) s on s.id = case when low then 'c-test' else coalesce(mentioned_id, 'c-other') end"""

def _word_model():
    """A stand-in for a model: it names the second word of the description, or fails where that has an odd number of letters."""
    import json
    import re

    def answer(prompt: str) -> str:
        word = re.search(r"Description: \S+ (\S+)", prompt).group(1)
        if len(word) % 2:
            raise RuntimeError("no answer")
        return "```json\n" + json.dumps({"category_id": None, "category_name": word.upper()}) + "\n```"

    return answer


def q_classify_model(spark, d):
    return classify_with_model(_posts(spark, d), _taxonomy(spark, d), _word_model)


SQL_CLASSIFY_MODEL = f"""
with named as (
  select p_partkey, arg_min(s.id, s.rk) as model_id from ({_JOBS_SQL}) j left join ({_SELECTABLE_SQL}) s
    on job_description <> '' and length(split_part(job_description, ' ', 2)) % 2 = 0 and lower(split_part(job_description, ' ', 2)) = lower(s.name)
  group by p_partkey)
select 'post-' || l.p_partkey as id, s.id as category_id, s.name as category_name
from ({_LOW_SQL}) l join ({_MENTION_SQL}) m on l.p_partkey = m.p_partkey join named n on n.p_partkey = l.p_partkey
join ({_SELECTABLE_SQL}) s on s.id = case when low then 'c-test' else coalesce(model_id, mentioned_id, 'c-other') end"""

_NAMES = [
    "classify_model", "category_parent", "selectable_categories", "rank_categories", "category_prompt", "low_info", "job_prompt",
    "category_exact", "category_mention", "mention_many_names", "assign_category", "classify_posts",
]
QUERIES = {f"q_{name}": globals()[f"q_{name}"] for name in _NAMES}
ORACLES = {f"q_{name}": globals()[f"SQL_{name.upper()}"] for name in _NAMES}
