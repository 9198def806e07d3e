"""Whole runs over the given tables: listing, stream, saved state, fetch results and deep pages, with the SQL they must agree with."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from catalog.common import pages
from catalog.feeds import FEED_TYPES
from catalog.pages import LETTERS_SQL
from gleaner.functions.staging import settled
from gleaner.operators.dedupe import known_urls
from gleaner.plans.classify import classify_stored
from gleaner.plans.ingest import scheduled_ingest
from gleaner.plans.listing import detail_records, kept_records, two_phase_records
from gleaner.session import checkpoint_dir, write_table
from gleaner.sources import sinks, tables
from gleaner.sources.posts import append_posts, read_posts
from gleaner.sources.tables import read_table
from gleaner.streaming import ingest as streaming

RUN = datetime(2024, 6, 1, 12)


def _folder(spark) -> str:
    """A fresh folder that every executor can reach."""
    return f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


def _numbered_model():
    """A stand-in for a model: the number in the page's address decides whether it fails, rambles or answers, and what."""
    import re

    places = ["Toronto, ON", "Lyon, France", "Reno, NV"]

    def answer(prompt: str) -> str:
        number = int(re.search(r"Page: \S*?/(\d+)", prompt).group(1))
        if number % 4 == 0:
            raise RuntimeError("no answer")
        if number % 4 == 1:
            return "I could not read this page"
        return json.dumps({"job_title": f"Job {number}", "location": places[number % 3], "perks_and_benefits": ["a", str(number)]})

    return answer


def q_listing_run(spark, d):
    details = pages(spark, d, spread=True).withColumn("listing_id", F.col("page_id") % 50)
    records = kept_records(detail_records(details, _numbered_model, parallel=2), 3, "page_id")
    return records.select("listing_id", "page_id", "parsed", "job_title", "location", "city", "state", "country", "perks_and_benefits", "source_url", _letters("html_content").alias("letters"))


def _letters(column: str):
    """What a piece of html shows, without white space."""
    text = F.regexp_replace(column, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(text, r"(?U)\s+", "")


SQL_LISTING_RUN = LETTERS_SQL.join((r"""
with n as (select page_id, page_id % 50 as listing_id, url, """, r""" as letters, cast(regexp_extract(url, '/(\d+)', 1) as bigint) as k from pages),
r as (select *, k % 4 > 1 as parsed, case k % 4 when 0 then 'Job Title Not Found' when 1 then '' else 'Job ' || k end as job_title from n),
p as (select *, row_number() over (partition by listing_id order by page_id) as place from r where job_title <> '')
select listing_id, page_id, parsed, job_title,
  case when not parsed then '' else ['Toronto, Ontario, Canada', 'Lyon, France', 'Reno, Nevada, United States'][k % 3 + 1] end as location,
  case when not parsed then '' else ['Toronto', 'Lyon', 'Reno'][k % 3 + 1] end as city,
  case when not parsed then '' else ['Ontario', 'France', 'Nevada'][k % 3 + 1] end as state,
  case when not parsed then '' else ['Canada', '', 'United States'][k % 3 + 1] end as country,
  case when not parsed then '' else 'a' || chr(10) || k end as perks_and_benefits, url as source_url, letters
from p where place <= 3"""))


def q_listing_two_phases(spark, d):
    """The first run sees every third page of a listing, the second all of them; listings with three records after the first are done."""
    details = pages(spark, d, spread=True).withColumn("listing_id", F.col("page_id") % 30)
    found = two_phase_records(details.filter("page_id % 90 < 30"), details, lambda rows: detail_records(rows, _numbered_model, include_html=False), 3, "page_id")
    return found.select("listing_id", "page_id", "job_title", "source_url")


SQL_LISTING_TWO_PHASES = r"""
with n as (select page_id, page_id % 30 as listing_id, url, page_id % 90 < 30 as shallow, cast(regexp_extract(url, '/(\d+)', 1) as bigint) as k from pages),
r as (select *, case k % 4 when 0 then 'Job Title Not Found' when 1 then '' else 'Job ' || k end as job_title from n),
a as (select * from r where shallow and job_title <> '' qualify row_number() over (partition by listing_id order by page_id) <= 3),
b as (select * from r where job_title <> '' qualify row_number() over (partition by listing_id order by page_id) <= 3),
more as (select listing_id from b group by 1 having count(*) > (select count(*) from a where a.listing_id = b.listing_id))
select listing_id, page_id, job_title, url as source_url from a where listing_id not in (select listing_id from more)
union all select listing_id, page_id, job_title, url from b where listing_id in (select listing_id from more)"""


def q_classify_update(spark, d):
    """Stored posts are classified and updated in place; the categories are the numbers of the second words, in order."""
    root = _folder(spark)
    part = read_table(spark, d, "part")
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    words = part.select(second.alias("name")).filter("name <> ''").distinct()
    numbered = words.select((F.ascii("name") * 1000 + F.length("name")).cast("string").alias("id"), "name", F.lit("root").alias("parent_id"))
    posts = part.select(
        F.concat(F.lit("https://jobs.example.com/"), F.col("p_partkey").cast("string")).alias("source_url"), F.initcap("p_name").alias("job_title"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("uses a "), "p_name")).otherwise("plain").alias("job_description"),
    )
    append_posts(posts, f"{root}/posts", RUN)
    classify_stored(spark, f"{root}/posts", numbered, _silent_model, datetime(2024, 6, 2))
    found = read_posts(spark, f"{root}/posts")
    return found.select("source_url", F.col("categoryId").cast("bigint").alias("category"), F.col("updatedAt").cast("string").alias("updated"))


def _silent_model():
    """A stand-in for a model that never knows, so the rules decide."""
    return lambda prompt: "no idea"


SQL_CLASSIFY_UPDATE = """
with c as (select distinct split_part(p_name, ' ', 2) as name from part where split_part(p_name, ' ', 2) <> ''),
m as (select p_partkey, arg_min(ascii(c.name) * 1000 + length(c.name), c.name) as category from part
  left join c on contains(lower(p_name), c.name) or contains(case when p_partkey % 3 = 0 then 'uses a ' || p_name else 'plain' end, c.name) group by p_partkey)
select 'https://jobs.example.com/' || p_partkey as source_url, cast(category as bigint) as category,
  case when category is null then '2024-06-01 12:00:00' else '2024-06-02 00:00:00' end as updated from m"""


def q_stream_ingest(spark, d):
    """Orders arrive as records of twenty feeds; two runs store ten of each feed and run."""
    root = _folder(spark)
    orders = read_table(spark, d, "orders")
    records = orders.select(
        F.concat(F.lit("https://jobs.example.com/"), F.col("o_orderkey").cast("string"), F.lit("?r=1")).alias("source_url"), F.col("o_orderpriority").alias("job_title"),
        F.lit("").alias("location"), F.format_string("feed-%02d", F.col("o_custkey") % 20).alias("feed_url"), F.col("o_orderkey").alias("pos"),
    )
    # Three batches, each of as many files as there are cores.
    files = spark.sparkContext.defaultParallelism
    records.repartition(3 * files, "pos").write.parquet(f"{root}/in")
    for _ in range(2):
        stream = streaming.read_arrivals(spark, f"{root}/in", records.schema, files_per_batch=files)
        streaming.incremental_ingest(stream, f"{root}/posts", f"{root}/check", RUN).awaitTermination()
    return read_posts(spark, f"{root}/posts").select("source_url", F.col("jobTitle").alias("job_title"))


SQL_STREAM_INGEST = """
with r as (select *, row_number() over (partition by o_custkey % 20 order by o_orderkey) as place from orders)
select 'https://jobs.example.com/' || o_orderkey || '?r=1' as source_url, o_orderpriority as job_title from r where place <= 20"""


def q_stream_first(spark, d):
    """Events arrive in four parts, one run each. Each comes twice in its part, the last ones of a part again in the next, and old ones at the very end."""
    root = _folder(spark)
    events = read_table(spark, d, "events", spread=True)
    part = F.floor(F.col("event_id") * 4 / events.count()) + 1  # events are numbered in the order of their time
    events = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), part.alias("part"))
    url = F.concat(F.lit("https://jobs.example.com/"), F.col("event_id").cast("string"))
    events = write_table(events)
    for part in range(1, 5):
        own = events.filter(F.col("part") == part).select(url.alias("url"), "ts")
        rows = own.unionByName(own.withColumn("url", F.concat("url", F.lit("?again=1"))))
        rows = rows.unionByName(events.filter(F.col("part") == part - 1).orderBy(F.desc("ts")).limit(50).select(F.concat(url, F.lit("#next")).alias("url"), "ts"))
        if part == 4:
            rows = rows.unionByName(events.filter("part = 1").select(F.concat(url, F.lit("/late")).alias("url"), "ts"))
        rows.write.mode("append").parquet(f"{root}/in")
        # A run reads all files of its part as one batch, so none of them is late because of another.
        stream = streaming.stream_first_per_key(streaming.read_arrivals(spark, f"{root}/in", "url string, ts timestamp"), event_time="ts", delay="1 hour")
        run = stream.select("url_key").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema("url_key string").parquet(f"{root}/out")


SQL_STREAM_FIRST = "select 'https://jobs.example.com/' || event_id as url_key from events"


def q_saved_state(spark, d):
    records = pages(spark, d, spread=False).select(F.col("url").alias("source_url"), F.col("page_id").cast("string").alias("job_id"))
    root = _folder(spark)
    sinks.save_state(records.limit(0), records.limit(0), root, datetime(2024, 5, 31))
    sinks.save_state(records, records, root, RUN)
    urls, saved = sinks.load_state(spark, root, None, records.schema)
    return saved.join(urls.select("source_url").distinct(), "source_url").select("source_url", "job_id", F.col("saved_at").cast("string").alias("saved_at"))


SQL_SAVED_STATE = "select url as source_url, cast(page_id as varchar) as job_id, '2024-06-01 12:00:00' as saved_at from pages"


def q_fetch_errors(spark, d):
    fetched = pages(spark, d, spread=False).select(
        F.lit("home").alias("page"), "url",
        F.when(F.col("page_id") % 5 == 0, F.lit(None).cast("int")).when(F.col("page_id") % 3 == 0, F.lit(404)).otherwise(F.lit(200)).alias("status_code"),
        F.when(F.col("page_id") % 5 != 0, F.col("html")).alias("html"), F.when(F.col("page_id") % 5 == 0, F.lit("timeout")).alias("error"),
    )
    parsed, errors = tables.split_fetch_results(fetched)
    return errors.unionByName(parsed.filter("html = ''").select(F.lit("empty").alias("page"), "url", "status_code", "error"))


SQL_FETCH_ERRORS = """
select 'home' as page, url, case when page_id % 5 = 0 then null when page_id % 3 = 0 then 404 end as status_code,
  case when page_id % 5 = 0 then 'timeout' else 'HTTP 404' end as error from pages where page_id % 5 = 0 or page_id % 3 = 0
union all select 'empty', url, null, 'timeout' from pages where page_id % 5 = 0"""


def q_existing_table(spark, d):
    pages(spark, d, spread=False).select("page_id", "url").createOrReplaceTempView("gleaner_stored_pages")
    return tables.first_existing_table(spark, ["gleaner_no_such_table", "gleaner_stored_pages"], "page_id bigint, url string")


SQL_EXISTING_TABLE = "select page_id, url from pages"


def q_known_limit(spark, d):
    known = known_urls(pages(spark, d, spread=False), ["url"], 100)
    stored = pages(spark, d, spread=False).select("url").distinct()
    return known.join(stored, known["source_url"] == stored["url"]).agg(F.count_distinct("source_url").alias("urls"))


SQL_KNOWN_LIMIT = "select least(100, count(distinct url)) as urls from pages"


def q_deep_page(spark, d):
    rows = read_table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderpriority")
    return sinks.page_of(rows, 120, "o_orderpriority")


SQL_DEEP_PAGE = """
select cast(o_orderkey as varchar) as id, o_orderpriority, cast(ceil((select count(*) from orders) / 10.0) as bigint) as total_pages
from orders order by o_orderpriority, cast(o_orderkey as varchar) limit 10 offset 1190"""

def _scheduled(spark, d):
    """One config of five feeds; what they list are the keys of the events, and those that end in 7 are stored already."""
    feeds = ",".join(f'{{"url":"https://feeds.example.com/{kind}"}}' for kind in FEED_TYPES)
    configs = spark.createDataFrame([("1", "m1", f'{{"feeds":[{feeds}]}}')], "id string, micrositeId string, config string")
    sites = spark.createDataFrame([("m1", "owner-1")], "id string, userId string")
    url = F.concat(F.lit("https://jobs.example.com/"), F.get_json_object("props", "$.k"))
    events = settled(read_table(spark, d, "events", spread=True).select("event_id", "event_type", "props"), {"url": url})
    links = events.select(F.concat(F.lit("https://feeds.example.com/"), "event_type").alias("feed_url"), "url", F.col("event_id").alias("pos")).filter("url is not null")
    records = links.select(F.col("url").alias("source_url")).distinct().withColumns({"job_title": F.concat(F.lit("Job "), F.substring_index("source_url", "/", -1)), "location": F.lit("")})
    posts = records.select("source_url").filter(F.endswith("source_url", F.lit("7")))
    return scheduled_ingest(configs, sites, links, records, posts, RUN)


def q_scheduled_ingest(spark, d):
    return _scheduled(spark, d)[0].select("source_url", F.col("jobTitle").alias("job_title"), F.col("postedById").alias("owner"), F.col("siteId").alias("site"))


def q_ingest_counts(spark, d):
    return _scheduled(spark, d)[1].withColumn("level", F.col("level").cast("bigint"))


def _sequential_sql(result: str) -> str:
    """The feeds one after another: each scrapes what no earlier feed saved and saves its first ten."""
    steps = [
        "e as (select event_type as feed, 'https://jobs.example.com/' || json_extract_string(props, '$.k') as url, min(event_id) as pos from events "
        "where json_extract_string(props, '$.k') is not null and not ends_with(json_extract_string(props, '$.k'), '7') group by all)",
        "s0 as (select * from e where false)",
    ]
    for i, feed in enumerate(FEED_TYPES, 1):
        steps.append(f"c{i} as (select * from e where feed = '{feed}' and url not in (select url from s{i - 1}))")
        steps.append(f"s{i} as (select * from s{i - 1} union all select * from (select * from c{i} order by pos, url limit 10) t)")
    scraped = " union all ".join(f"select * from c{i}" for i in range(1, len(FEED_TYPES) + 1))
    steps += [f"s as (select * from s{len(FEED_TYPES)})", f"c as ({scraped})"]
    return f"with {', '.join(steps)} {result}"


SQL_SCHEDULED_INGEST = _sequential_sql("select url as source_url, 'Job ' || split_part(url, '/', 4) as job_title, 'owner-1' as owner, 'm1' as site from s")
SQL_INGEST_COUNTS = _sequential_sql("""
select case when grouping(k) = 0 then k end as config_id, case when grouping(f) = 0 then f end as feed_url, count(*) as scraped, count(*) as new, count(taken) as saved, grouping(k, f) as level
from (select '1' as k, 'https://feeds.example.com/' || c.feed as f, s.url as taken from c left join s on c.feed = s.feed and c.url = s.url) t group by rollup (k, f)""")

_NAMES = ["scheduled_ingest", "ingest_counts", "listing_run", "listing_two_phases", "classify_update", "stream_ingest", "stream_first", "saved_state", "fetch_errors", "existing_table", "known_limit", "deep_page"]
QUERIES = {f"q_{name}": globals()[f"q_{name}"] for name in _NAMES}
ORACLES = {f"q_{name}": globals()[f"SQL_{name.upper()}"] for name in _NAMES}
