"""URL, link and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import HOST_SQL, KEY_SQL, pages, pages_with_host, pick, pick_sql, sql_list
from gleaner import constants as K
from gleaner.functions import urls as U
from gleaner.operators import dedupe, ingest
from gleaner.sources.tables import lookup_by_id, read_table

SITE = "https://jobs.example.com"
ENGLISH = "%lang=\"en\"%"


def _variants(spark, d):
    p = pages_with_host(spark, d)
    board = F.lit("/JB/OpportunityDetail?opportunityId=")
    urls = F.array(
        F.col("url"),
        F.concat(F.lit("HTTPS://"), "host", board, F.lit("AB%2D"), F.col("page_id").cast("string"), F.lit("&z=2")),
        F.concat(F.lit("http://"), "host", board),
    )
    return p.select("page_id", F.explode(urls).alias("url"))


_VARIANTS_SQL = f"""
  select page_id, unnest([url,
    'HTTPS://' || {HOST_SQL} || '/JB/OpportunityDetail?opportunityId=AB%2D' || page_id || '&z=2',
    'http://' || {HOST_SQL} || '/JB/OpportunityDetail?opportunityId=']) as url from pages"""


def q_url_key(spark, d):
    return _variants(spark, d).select("page_id", "url", U.url_key(F.col("url")).alias("url_key"))


SQL_URL_KEY = f"""
with v as ({_VARIANTS_SQL}),
b as (select *, lower(regexp_extract(url, '^[A-Za-z]+')) || regexp_extract(url, '^[A-Za-z]+([^?#]*)', 1) as base,
             regexp_extract(url, '[?&]opportunityId=([^&#]+)', 1) as oid from v)
select page_id, url, case when contains(base, 'OpportunityDetail') and oid <> ''
  then base || '?opportunityId=' || url_decode(oid) else base end as url_key from b"""


def _stored(spark, d):
    """Post-like rows whose URL stands under two spellings."""
    url = F.col("url")
    return pages(spark, d).select(
        F.when(url.like("https:%"), url).when(F.contains(url, F.lit("?")), F.lit("")).alias("sourceUrl"),
        url.alias("source_url"),
    )


def q_known_urls(spark, d):
    return dedupe.known_urls(_stored(spark, d), K.SOURCE_URL_ALIASES)


SQL_KNOWN_URLS = """
select distinct coalesce(case when url like 'https:%' then url when contains(url, '?') then '' end, url) as source_url
from pages where coalesce(case when url like 'https:%' then url when contains(url, '?') then '' end, url) <> ''"""


def q_lookup_orders(spark, d):
    returned = read_table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    orders = read_table(spark, d, "orders", spread=True).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return lookup_by_id(orders, returned, "o_orderkey")


SQL_LOOKUP_ORDERS = """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders
where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')"""


def _english(spark, d):
    return pages(spark, d).filter(F.col("html").like(ENGLISH)).select(F.col("url").alias("source_url"))


def q_anti_known(spark, d):
    return dedupe.anti_known(pages(spark, d).select("page_id", "url"), _english(spark, d))


SQL_ANTI_KNOWN = f"""
select page_id, url from pages p where not exists (
  select 1 from pages k where k.html like '{ENGLISH}'
  and regexp_replace(k.url, '[?#].*$', '') = regexp_replace(p.url, '[?#].*$', ''))"""


def q_anti_raw(spark, d):
    rows = pages(spark, d).select(
        "page_id", F.when(F.contains("url", F.lit("/fr/")), F.lit("")).otherwise(F.col("url")).alias("url")
    )
    return dedupe.anti_known_raw(rows, pages(spark, d).filter(F.contains("url", F.lit("?"))).select(F.col("url").alias("source_url")))


SQL_ANTI_RAW = """
select page_id, url from pages where not contains(url, '/fr/') and not contains(url, '?')"""


def q_known_after(spark, d):
    p = pages(spark, d)
    known = p.filter(F.col("url").like("https:%")).select(F.col("url").alias("source_url"))
    saved = p.filter(F.contains("url", F.lit("/en/"))).select(F.col("url").alias("source_url"))
    return dedupe.known_after_run(known, saved)


SQL_KNOWN_AFTER = """
select url as source_url from pages where url like 'https:%'
union select url from pages where contains(url, '/en/')"""

# --- links named by href --------------------------------------------------------------------

HREF = 'href="([^"]*)"'


def _links(spark, d):
    """Every href of every page on one site, so targets repeat across pages."""
    hrefs = F.regexp_extract_all("html", F.lit(HREF), 1)
    rows = pages_with_host(spark, d).select("page_id", "host", F.posexplode(hrefs).alias("pos", "href"))
    return rows.select(
        "page_id", "host", F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit(SITE), "href").alias("url"), "href"
    )


_LINKS_SQL = f"""
  select page_id, {HOST_SQL} as host, i - 1 as pos, '{SITE}' || hrefs[i] as url, hrefs[i] as href
  from (select *, regexp_extract_all(html, '{HREF}', 1) as hrefs from pages) s, unnest(range(1, len(hrefs) + 1)) as t(i)"""


def q_first_per_key(spark, d):
    keyed = _links(spark, d).withColumn("url_key", U.url_key(F.col("url")))
    kept = dedupe.drop_landing(keyed, f"{SITE}/de?all=1")
    return dedupe.first_per_key(kept, "url_key", ["page_id", "pos"]).select("url_key", "url", "page_id", "pos")


SQL_FIRST_PER_KEY = f"""
with l as ({_LINKS_SQL}), k as (select *, {KEY_SQL} as url_key from l)
select url_key, arg_min(url, page_id * 100000 + pos) as url, min(page_id * 100000 + pos) // 100000 as page_id,
       min(page_id * 100000 + pos) % 100000 as pos
from k where url_key <> '{SITE}/de' group by url_key"""


def q_ordered_links(spark, d):
    placed = _links(spark, d).withColumn("place", F.struct("page_id", "pos"))
    return dedupe.ordered_distinct(placed, "url", "place").select("url", "place.page_id", "place.pos")


SQL_ORDERED_LINKS = f"""
with l as ({_LINKS_SQL}), r as (select url, page_id, pos, row_number() over (partition by url order by page_id, pos) as rn from l)
select url, page_id, pos from r where rn = 1"""


def q_union_links(spark, d):
    links = _links(spark, d).withColumn("listing_id", F.col("page_id"))
    own = pages(spark, d).select(F.col("page_id").alias("listing_id"), F.lit(0).cast("bigint").alias("pos"), "url")
    long = links.filter(F.length("href") > 4)
    return dedupe.union_links([own, long, links]).select(
        "listing_id", "url", F.col("place.source").cast("bigint").alias("source"), F.col("place.pos").alias("pos")
    )


SQL_UNION_LINKS = f"""
with l as ({_LINKS_SQL}),
s as (select page_id as listing_id, url, 0 as source, 0 as pos from pages
      union all select page_id, url, 1, pos from l where length(href) > 4
      union all select page_id, url, 2, pos from l),
r as (select *, row_number() over (partition by listing_id, url order by source, pos) as rn from s)
select listing_id, url, source, pos from r where rn = 1"""


def q_link_buffer(spark, d):
    links = _links(spark, d).select(
        F.col("host").alias("listing_id"), F.col("page_id").alias("chunk_no"), F.col("pos").alias("place"), "url"
    )
    return ingest.buffer_links(links, 1).select("listing_id", "url", "place.chunk_no", F.col("place.place").alias("pos"))


SQL_LINK_BUFFER = f"""
with l as ({_LINKS_SQL}),
c as (select host, page_id, url, min(pos) as pos from l group by all),
k as (select *, row_number() over (partition by host, page_id order by pos) as rn from c),
f as (select host, url, min(struct_pack(p := page_id, q := pos)) as place from k where rn <= 13 group by all),
g as (select *, row_number() over (partition by host order by place) as rn from f),
e as (select host, place.p as last_chunk from g where rn = 13)
select g.host as listing_id, url, place.p as chunk_no, place.q as pos
from g left join e on g.host = e.host where last_chunk is null or place.p <= last_chunk"""

# --- URL predicates and builders --------------------------------------------------------------

SUFFIXES = ["/jobs/17", "/career", "?jobId=9", "/x?id=4", "/about", "", "/JobBoard/ab-1/OpportunityDetail", "/positions"]


def _suffixed(spark, d):
    return pages_with_host(spark, d).select(
        "page_id", F.concat(F.lit("https://"), "host", pick(SUFFIXES, F.col("page_id"))).alias("url")
    )


_SUFFIXED_SQL = f"select page_id, 'https://' || {HOST_SQL} || {pick_sql(SUFFIXES, 'page_id')} as url from pages"


def q_job_url(spark, d):
    return _suffixed(spark, d).withColumn("is_job", U.is_job_url(F.col("url")))


SQL_JOB_URL = f"""
with s as ({_SUFFIXED_SQL})
select page_id, url, regexp_matches(lower(url), '/careers/jobs/[0-9]+|/jobs?/[0-9]+|jobid=[0-9]+|id=[0-9]+')
  or len(list_filter({sql_list(K.JOB_URL_WORDS)}, lambda w: contains(lower(url), w))) > 0 as is_job from s"""

ANCHOR = '<a href="([^"]*)">([^<]*)</a>'


def q_valid_links(spark, d):
    html = pages(spark, d)
    pairs = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(ANCHOR), 1).alias("href"), F.regexp_extract_all("html", F.lit(ANCHOR), 2).alias("text")
    )
    rows = html.select("page_id", F.posexplode(pairs).alias("pos", "a")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "a.href", "a.text"
    )
    return rows.withColumn("valid", U.is_valid_link(F.col("text"), F.col("href")))


SQL_VALID_LINKS = f"""
with s as (select page_id, regexp_extract_all(html, '{ANCHOR}', 1) as hs, regexp_extract_all(html, '{ANCHOR}', 2) as ts from pages),
r as (select page_id, i - 1 as pos, hs[i] as href, ts[i] as text from s, unnest(range(1, len(hs) + 1)) as t(i))
select *, not (len(list_filter({sql_list(K.NAVIGATION_WORDS)}, lambda w: contains(lower(text), w) or contains(lower(href), w))) > 0
  or length(trim(text)) < 3 or list_contains({sql_list(K.GENERIC_LINK_TEXTS)}, lower(trim(text)))) as valid from r"""

ODD_URLS = ["", "  ", "not a url", "http://", "mailto:a@b.co", "https://", "//host/x", "http://a b/c", "ftp://files.example.com"]


def q_valid_url(spark, d):
    rows = pages(spark, d).select("page_id", F.explode(F.array(F.col("url"), pick(ODD_URLS, F.col("page_id")))).alias("url"))
    return rows.withColumn("valid", U.valid_url(F.col("url")))


SQL_VALID_URL = f"""
with s as (select page_id, unnest([url, {pick_sql(ODD_URLS, 'page_id')}]) as url from pages)
select *, case when regexp_matches(trim(url), '^(https?|ftp|wss?):') then regexp_matches(trim(url), '^[a-z]+:/*[^\\s/?#:@]+([/?#:].*)?$')
  else regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*:') end as valid from s"""


def _rich_html(spark, d):
    """Pages whose links name detail pages, in the spellings the passes look for."""
    number = F.col("page_id").cast("string")
    html = F.concat(
        F.regexp_replace("html", 'href="/', F.concat(F.lit('href="/Careers/jobs/'), number, F.lit("-"))),
        F.lit('<script>{"u":"https:\\/\\/h.com\\/X\\/Careers\\/jobs\\/'), number,
        F.lit('"} see https://h.com/jobs/'), number, F.lit(').</script><a data-url="board/../OpportunityDetail?opportunityId=ab-'), number,
        F.lit('">x</a>'),
    )
    return pages_with_host(spark, d).select("page_id", F.concat(F.lit("https://"), "host", F.lit("/a/b")).alias("url"), html.alias("html"))


def q_detail_urls(spark, d):
    rows = _rich_html(spark, d)
    urls = U.detail_url_filter(U.detail_urls(F.col("html"), F.col("url")))
    return rows.select("page_id", F.posexplode(urls).alias("pos", "url")).withColumn("pos", F.col("pos").cast("bigint"))


SQL_DETAIL_URLS = f"""
with s as (select page_id, {HOST_SQL} as host, regexp_extract_all(html, 'href="/([^"]*)"', 1) as hs from pages),
u as (select page_id, list_concat(list_concat(['https://h.com/jobs/' || page_id],
        list_transform(hs, lambda h: 'https://' || host || '/Careers/jobs/' || page_id || '-' || h)),
        ['https://h.com/X/Careers/jobs/' || page_id, 'https://' || host || '/a/OpportunityDetail?opportunityId=ab-' || page_id]) as us from s),
r as (select page_id, i, us[i] as url from u, unnest(range(1, len(us) + 1)) as t(i)),
f as (select page_id, url, min(i) as i from r group by all)
select page_id, row_number() over (partition by page_id order by i) - 1 as pos, url from f"""

ROOTS = ["?cxembeddedroot=%2FX%2FCareers", "?a=1&cxembeddedroot=Brandt%2FCareers%3Fq%3D2%23top", "?cxembeddedroot=%2FX%3Fembedded%3Dtrue", ""]
CODES = ["C1", " ", "C2"]


def q_embedded_listing(spark, d):
    rows = pages_with_host(spark, d).select(
        "page_id",
        F.concat(F.lit("https://"), "host", F.lit("/careers"), pick(ROOTS, F.col("page_id"))).alias("landing"),
        pick(CODES, F.col("page_id")).alias("code"),
    )
    listing = U.embedded_listing_url(F.col("landing"), F.lit("https://jobs.example.net"), F.col("code"), F.lit("P"))
    return rows.select("page_id", "landing", listing.alias("listing_url"))


SQL_EMBEDDED_LISTING = f"""
select page_id, 'https://' || {HOST_SQL} || '/careers' || {pick_sql(ROOTS, 'page_id')} as landing,
  case page_id % 4 when 0 then 'https://jobs.example.net/X/Careers?embedded=true'
    when 1 then 'https://jobs.example.net/Brandt/Careers?q=2'
    when 2 then 'https://jobs.example.net/X?embedded=true'
    else case when trim({pick_sql(CODES, 'page_id')}) <> '' then 'https://jobs.example.net/' || {pick_sql(CODES, 'page_id')} || '/P?embedded=true' end
  end as listing_url from pages"""


def q_page_slug(spark, d):
    return pages(spark, d).select("page_id", U.page_slug(F.col("url")).alias("slug"))


SQL_PAGE_SLUG = """
select page_id, regexp_replace(replace(replace(url, 'https://', ''), 'http://', ''), '[^A-Za-z0-9_.-]', '_', 'g') as slug from pages"""


def q_tag_from_href(spark, d):
    # Every letter of a link target may be escaped; a plus sign stays one.
    rows = _links(spark, d).select("page_id", "pos", F.concat(F.url_encode("href"), F.lit("+x/")).alias("href"))
    rows = rows.withColumn("href", F.concat(F.lit("/t/"), F.replace("href", F.lit("%2F"), F.lit("/"))))
    return rows.select("page_id", "pos", U.tag_from_href(F.col("href")).alias("tag"))


SQL_TAG_FROM_HREF = f"""
with l as ({_LINKS_SQL})
select page_id, pos, regexp_extract(href, '([^/]*)$', 1) || '+x' as tag from l"""

# --- listing, cap and filter order ------------------------------------------------------------

TITLE = "<h1>([^<]*)</h1>"


def _candidates(spark, d):
    p = pages_with_host(spark, d)
    shown = F.when(F.length(F.regexp_extract("html", TITLE, 1)) > 30, F.regexp_extract("html", TITLE, 1)).otherwise("  ")
    return p.select("page_id", "host", "url", shown.alias("job_title"), F.concat_ws(", ", "host", pick(["NV", "France", ""], F.col("page_id"))).alias("location"))


_CANDIDATES_SQL = f"""
  select page_id, {HOST_SQL} as host, url, case when length(regexp_extract(html, '{TITLE}', 1)) > 30 then regexp_extract(html, '{TITLE}', 1) else '  ' end as job_title
  from pages"""


def q_take_first(spark, d):
    kept = ingest.require_title(_candidates(spark, d))
    return ingest.take_first(kept, 3, "page_id", "host").select("page_id", "host", "url", "job_title")


SQL_TAKE_FIRST = f"""
with c as ({_CANDIDATES_SQL}), r as (select *, row_number() over (partition by host order by page_id) as rn from c where trim(job_title) <> '')
select page_id, host, url, job_title from r where rn <= 3"""


def q_cap_per_group(spark, d):
    rows = pages_with_host(spark, d).select("page_id", "host", "url")
    return ingest.cap_per_group(rows, "host", "page_id", rank="rank").withColumn("rank", F.col("rank").cast("bigint"))


SQL_CAP_PER_GROUP = f"""
with r as (select page_id, {HOST_SQL} as host, url, row_number() over (partition by {HOST_SQL} order by page_id) as rank from pages)
select * from r where rank <= 10"""


def q_new_records(spark, d):
    """Flagship: identity, known pages out, records with a title, first ten per host."""
    keyed = _candidates(spark, d).withColumn("url_key", U.url_key(F.col("url")))
    first = dedupe.first_per_key(keyed, "url_key", "page_id")
    fresh = ingest.require_title(dedupe.anti_known(first, _english(spark, d), key="url_key"))
    capped = ingest.cap_per_group(fresh, "host", "page_id", rank="rank")
    return capped.select("page_id", "host", "url_key", "job_title", F.col("rank").cast("bigint").alias("rank"))


SQL_NEW_RECORDS = f"""
with c as (select *, {KEY_SQL} as url_key from ({_CANDIDATES_SQL}) s),
f as (select * from c qualify row_number() over (partition by url_key order by page_id) = 1),
n as (select * from f where trim(job_title) <> '' and not exists (
  select 1 from pages k where k.html like '{ENGLISH}' and regexp_replace(k.url, '[?#].*$', '') = f.url_key))
select * from (select page_id, host, url_key, job_title, row_number() over (partition by host order by page_id) as rank from n) r
where rank <= 10"""

_NAMES = [
    "url_key", "known_urls", "lookup_orders", "anti_known", "anti_raw", "known_after", "first_per_key", "ordered_links",
    "union_links", "link_buffer", "job_url", "valid_links", "valid_url", "detail_urls", "embedded_listing", "page_slug",
    "tag_from_href", "take_first", "cap_per_group", "new_records",
]
QUERIES = {f"q_{name}": globals()[f"q_{name}"] for name in _NAMES}
ORACLES = {f"q_{name}": globals()[f"SQL_{name.upper()}"] for name in _NAMES}
