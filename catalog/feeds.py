"""Feed, cap and run queries over events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.operators import dedupe, ingest, spillover
from gleaner.sources.tables import read_table

FEED_TYPES = ["click", "error", "purchase", "signup", "view"]


def _configs(spark, d):
    """One config per user; its feeds are the user's event types, its JSON is broken for some."""
    feed = F.concat(
        F.lit('{"url":"'), F.when(F.col("n") > 3, F.concat(F.lit("https://feeds.example.com/"), "event_type")).otherwise(F.lit("")),
        F.lit('","fields":{"location":'), (F.col("top") > 95).cast("string"), F.lit("}}"),
    )
    types = read_table(spark, d, "events", spread=True).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    users = types.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_type", feed.alias("feed")))).alias("feeds"))
    body = F.array_join(F.transform("feeds", lambda f: f["feed"]), ",")
    tail = F.when(F.size("feeds") == 4, F.lit("]")).otherwise(F.lit("]}"))
    return users.select(
        F.col("user_id").cast("string").alias("id"),
        F.when(F.col("user_id") % 10 == 3, F.lit("")).otherwise(F.concat(F.lit("site-"), F.col("user_id").cast("string"))).alias("micrositeId"),
        F.concat(F.lit('{"feeds":['), body, tail).alias("config"),
    )


def q_explode_feeds(spark, d):
    return ingest.explode_feeds(_configs(spark, d)).withColumn("feed_pos", F.col("feed_pos").cast("bigint"))


SQL_EXPLODE_FEEDS = """
with t as (select user_id, event_type, count(*) as n, max(value) as top from events group by all),
r as (select *, row_number() over (partition by user_id order by event_type) - 1 as feed_pos, count(*) over (partition by user_id) as k from t)
select cast(user_id as varchar) as config_id, 'site-' || user_id as site_id, feed_pos, 'https://feeds.example.com/' || event_type as feed_url,
  top > 95 as filter_location from r where k <> 4 and n > 3 and user_id % 10 <> 3"""


def q_owner_lookup(spark, d):
    sites = read_table(spark, d, "customer", spread=True).select(
        F.concat(F.lit("site-"), F.col("c_custkey").cast("string")).alias("id"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).when(F.col("c_acctbal") > 0, F.col("c_name")).alias("userId"),
    )
    configs = _configs(spark, d).select(F.col("id").alias("config_id"), F.concat(F.lit("site-"), "id").alias("site_id"))
    return ingest.owner_for_site(configs, sites)


SQL_OWNER_LOOKUP = f"""
select cast(u.user_id as varchar) as config_id, 'site-' || u.user_id as site_id,
  case when c_mktsegment <> 'BUILDING' and c_acctbal > 0 then c_name else '{K.DEFAULT_OWNER}' end as owner_id
from (select distinct user_id from events) u left join customer on c_custkey = user_id"""


def q_ingest_summary(spark, d):
    rows = read_table(spark, d, "events", spread=True).select(
        F.col("user_id").alias("config_id"), F.col("event_type").alias("feed_url"),
        (F.col("value") > 20).alias("is_new"), (F.col("value") > 60).alias("is_saved"),
    )
    return ingest.ingest_summary(rows).withColumn("level", F.col("level").cast("bigint"))


SQL_INGEST_SUMMARY = """
select user_id as config_id, event_type as feed_url, count(*) as scraped, count(*) filter (value > 20) as new,
  count(*) filter (value > 60) as saved, grouping(user_id, event_type) as level from events group by rollup (user_id, event_type)"""


def q_cap_spillover(spark, d):
    """Five feeds in order offer the same addresses; each saves its first ten new ones."""
    rows = read_table(spark, d, "events", spread=True).select(
        F.col("event_type").alias("feed"), F.get_json_object("props", "$.k").alias("url"), "event_id"
    )
    saved = spillover.cap_with_spillover(rows.filter("url is not null"), ["feed"], "url", "event_id")
    return saved.select("feed", "url", "event_id")


def _spillover_sql() -> str:
    steps = [
        "e as (select event_type as feed, json_extract_string(props, '$.k') as url, min(event_id) as event_id from events group by all)",
        "s0 as (select * from e where false)",
    ]
    for i, feed in enumerate(FEED_TYPES, 1):
        steps.append(
            f"s{i} as (select * from s{i - 1} union all select * from (select * from e where feed = '{feed}' and url is not null "
            f"and url not in (select url from s{i - 1}) order by event_id limit {K.FEED_CAP}) t)"
        )
    return f"with {', '.join(steps)} select feed, url, event_id from s{len(FEED_TYPES)}"


SQL_CAP_SPILLOVER = _spillover_sql()


def q_cap_many_feeds(spark, d):
    """Every user is a feed, in order of the user's number; four events in a row offer the same address."""
    rows = read_table(spark, d, "events", spread=True).select("user_id", F.floor(F.col("event_id") / 4).alias("page"), "event_id")
    saved = spillover.cap_with_spillover(rows.withColumn("url", F.concat(F.lit("https://jobs.example.com/"), F.col("page").cast("string"))), ["user_id"], "url", "event_id")
    return saved.select("user_id", "url", "event_id")


# One feed after the other; what was saved so far travels as a list.
SQL_CAP_MANY_FEEDS = """
with recursive e as (
  select user_id, event_id // 4 as page, min(event_id) as event_id, dense_rank() over (order by user_id) as feed from events group by user_id, event_id // 4),
s as (
  select 0::bigint as feed, []::bigint[] as taken, []::bigint[] as fresh
  union all
  select feed, list_concat(taken, fresh) as taken, fresh from (
    select s.feed + 1 as feed, any_value(taken) as taken, coalesce((list(page order by event_id) filter (not list_contains(taken, page)))[1:10], []) as fresh
    from s join e on e.feed = s.feed + 1 group by s.feed) t)
select user_id, 'https://jobs.example.com/' || e.page as url, event_id from (select feed, unnest(fresh) as page from s) f join e on e.feed = f.feed and e.page = f.page"""


def q_prefer_run(spark, d):
    lines = read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linestatus") == "F", 1).otherwise(2).cast("bigint").alias("run")
    )
    return ingest.prefer_larger_run(lines, "l_orderkey", "run")


SQL_PREFER_RUN = """
with l as (select l_orderkey, l_linenumber, l_partkey, case when l_linestatus = 'F' then 1 else 2 end as run from lineitem),
c as (select l_orderkey, run, count(*) as n from l group by all),
b as (select * from c qualify row_number() over (partition by l_orderkey order by n desc, run) = 1)
select l.l_orderkey, l_linenumber, l_partkey, cast(l.run as bigint) as run from l join b on l.l_orderkey = b.l_orderkey and l.run = b.run"""


def q_dedupe_composite(spark, d):
    orders = read_table(spark, d, "orders", spread=True).select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 50).alias("title"), F.col("o_orderpriority").alias("url"),
        F.when(F.col("o_totalprice") > 250000, F.col("o_orderstatus")).alias("image"), "o_orderkey",
    )
    return dedupe.dedupe_composite(orders, ["title", "url", "image"], "o_orderkey")


SQL_DEDUPE_COMPOSITE = """
select case when o_orderstatus <> 'P' then o_custkey % 50 end as title, o_orderpriority as url,
  case when o_totalprice > 250000 then o_orderstatus end as image, min(o_orderkey) as o_orderkey from orders group by 1, 2, 3"""


def q_dedupe_record(spark, d):
    orders = read_table(spark, d, "orders", spread=True).select(
        F.when(F.col("o_totalprice") > 150000, F.concat(F.lit(" "), (F.col("o_custkey") % 40).cast("string"))).alias("name"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).otherwise("  ").alias("city"),
        "o_orderkey",
    )
    return dedupe.dedupe_record(orders, ["name", "city"], "o_orderkey").select("o_orderkey", F.trim("name").alias("name"), F.trim("city").alias("city"))


SQL_DEDUPE_RECORD = """
with r as (select case when o_totalprice > 150000 then cast(o_custkey % 40 as varchar) end as name,
  case when o_orderstatus = 'O' then o_orderpriority else '' end as city, o_orderkey from orders)
select min(o_orderkey) as o_orderkey, name, city from r where name is not null or city <> '' group by name, city"""


def q_union_if_empty(spark, d):
    orders = read_table(spark, d, "orders", spread=True).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    boxes = orders.filter("o_orderstatus = 'F' and o_totalprice > 300000")
    return dedupe.union_if_empty(boxes, orders.filter("o_orderstatus = 'O'"), "o_custkey")


SQL_UNION_IF_EMPTY = """
with b as (select o_custkey, o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 300000)
select * from b union all
select o_custkey, o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'O' and o_custkey not in (select o_custkey from b)"""

_NAMES = [
    "explode_feeds", "owner_lookup", "ingest_summary", "cap_spillover", "cap_many_feeds", "prefer_run", "dedupe_composite", "dedupe_record",
    "union_if_empty",
]
QUERIES = {f"q_{name}": globals()[f"q_{name}"] for name in _NAMES}
ORACLES = {f"q_{name}": globals()[f"SQL_{name.upper()}"] for name in _NAMES}
