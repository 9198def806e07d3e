"""Html queries over whole pages. Where the given pages lack a kind of block, every page gets one."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import pages, strip_sql
from gleaner.operators import company as M
from gleaner.operators import contacts as C
from gleaner.operators import pages as P
from gleaner.operators.dedupe import ordered_distinct
from gleaner.plans.company import profiles_with_model

SITE_SQL = "regexp_extract(url, '^[a-z]+://[^/?#]+')"
# Text pieces of markup: scripts and styles out, tags as cuts, entities read.
_ENTITIES = [("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&nbsp;", "chr(160)"), ("&quot;", "chr(34)"), ("&#x27;", "chr(39)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")]


def _pieces_sql(html: str) -> str:
    quiet = f"regexp_replace({html}, '(?s)<(script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>', '<x>', 'g')"
    text = "p"
    for entity, char in _ENTITIES:
        # A title may be cut inside an entity; these names are read without their semicolon, too.
        text = f"regexp_replace({text}, '{entity}?', {char}, 'g')"
    stripped = strip_sql(text)
    return f"list_filter(list_transform(string_split_regex({quiet}, '(?s)<!--.*?-->|<[^>]*>'), lambda p: {stripped}), lambda p: p <> '')"


def _tidy_lines_sql(pieces: str) -> str:
    return f"""array_to_string(list_filter(list_transform(string_split(array_to_string({pieces}, chr(10)), chr(10)),
      lambda l: {strip_sql("regexp_replace(replace(l, chr(160), ' '), '[ \t\r\f\v]+', ' ', 'g')")}), lambda l: l <> ''), chr(10))"""


def q_html_nodes(spark, d):
    return P.html_nodes(pages(spark, d, spread=True)).select(
        "page_id", "node", "parent", "pre", "post", "depth", "tag", F.to_json("attrs").alias("attrs"), "own_text", "abs_href", "abs_src"
    )


def q_node_tags(spark, d):
    nodes = P.html_nodes(pages(spark, d, spread=True)).filter(~F.startswith("tag", F.lit("#")))
    return nodes.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


SQL_NODE_TAGS = """
with t as (select page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) as tag from pages)
select page_id, tag, count(*) as n from t group by all"""


def q_page_text(spark, d):
    return P.page_text(pages(spark, d, spread=True)).select("page_id", "page_text")


SQL_PAGE_TEXT = f"select page_id, {_tidy_lines_sql(_pieces_sql('html'))} as page_text from pages"


def q_main_content(spark, d):
    rows = P.parse_pages(pages(spark, d, spread=True))
    held = rows.withColumn("main", P.main_content(F.col("nodes")))
    return held.select("page_id", F.array_join(P.text_pieces(F.col("main")), "\n").alias("main_text"))


_BODY_SQL = "regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)$', 1), '(?s)<footer>.*?(</footer>|$)', '', 'g')"
SQL_MAIN_CONTENT = f"select page_id, array_to_string({_pieces_sql(_BODY_SQL)}, chr(10)) as main_text from pages"


# --- links ----------------------------------------------------------------------------------


def q_job_links(spark, d):
    marked = pages(spark, d, spread=True).withColumn("html", F.replace("html", F.lit('href="/'), F.lit('href="/job/')))
    links = ordered_distinct(P.job_links(marked), ["listing_id", "url"], "place")
    return links.select("listing_id", "url", F.col("place.rank").cast("bigint").alias("selector"))


SQL_JOB_LINKS = f"""
with h as (select page_id, {SITE_SQL} as site, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) as href from pages)
select distinct page_id as listing_id, site || '/job/' || replace(href, '&amp;', '&') as url, 14 as selector from h"""


def q_abs_links(spark, d):
    rows = P.parse_pages(pages(spark, d, spread=True))
    return rows.select("page_id", F.posexplode(F.transform(P.page_links(F.col("nodes")), lambda n: n["href"])).alias("pos", "url")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


SQL_ABS_LINKS = f"""
with h as (select page_id, {SITE_SQL} as site, regexp_extract_all(html, 'href="(/[^"]*)"', 1) as hs from pages)
select page_id, i - 1 as pos, site || replace(hs[i], '&amp;', '&') as url from h, unnest(range(1, len(hs) + 1)) as t(i)"""


def q_links_outside_footer(spark, d):
    """The navigation of French pages is marked as header, so its links drop out."""
    french = F.contains("html", F.lit('lang="fr"'))
    marked = pages(spark, d, spread=True).withColumn(
        "html", F.when(french, F.replace("html", F.lit("<nav>"), F.lit('<nav class="site-Header">'))).otherwise(F.col("html"))
    )
    return P.parse_pages(marked).select("page_id", F.explode(F.transform(P.page_links(F.col("nodes")), lambda n: n["href"])).alias("url"))


SQL_LINKS_OUTSIDE_FOOTER = f"""
select page_id, {SITE_SQL} || replace(unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)), '&amp;', '&') as url
from pages where not contains(html, 'lang="fr"')"""


def q_page_urls(spark, d):
    """Navigations become pagers; those of German pages number their pages."""
    german = F.contains("html", F.lit('lang="de"'))
    html = F.replace("html", F.lit("<nav>"), F.lit('<nav class="pagination">'))
    html = F.when(german, F.replace(html, F.lit('<a href="/'), F.lit('<a href="?page=1'))).otherwise(html)
    urls = P.page_urls(pages(spark, d, spread=True).withColumn("html", html))
    return urls.select("listing_id", F.col("pos").cast("bigint").alias("pos"), "url")


SQL_PAGE_URLS = f"""
with h as (select page_id, url, contains(html, 'lang="de"') as german, regexp_extract_all(html, '<a href="/([^"]*)"', 1) as hs from pages),
n as (select page_id, i, regexp_replace(url, '[?#].*$', '') || '?page=1' || replace(hs[i], '&amp;', '&') as u from h, unnest(range(1, len(hs) + 1)) as t(i) where german),
m as (select n.page_id, u, min(i) as i from n join pages p on p.page_id = n.page_id where u <> p.url group by all),
r as (select page_id, row_number() over (partition by page_id order by i) - 1 as pos, u from m)
select page_id as listing_id, pos, u as url from r where pos < 9
union all
select page_id, k - 2, url || '?page=' || k from h, unnest(range(2, 11)) as t(k) where len(hs) > 0 and not german"""


def _put_in(html, blocks):
    """Blocks before the article of a page, or at the end of a page without one."""
    return F.when(F.contains(html, F.lit("<article>")), F.replace(html, F.lit("<article>"), blocks)).otherwise(F.concat(html, blocks))


def q_job_iframes(spark, d):
    number = F.col("page_id").cast("string")
    frames = F.concat(
        F.lit('<iframe src="/careers/'), number, F.lit('"></iframe><iframe src="https://ads.example.com"></iframe><iframe src=" /careers/'), number,
        F.lit('"></iframe><iframe src="x?Embedded=TRUE"></iframe><article>'),
    )
    marked = pages(spark, d, spread=True).withColumn("html", _put_in(F.col("html"), frames))
    return P.job_iframes(marked).select("listing_id", F.col("pos").cast("bigint").alias("pos"), F.regexp_replace("url", "[^/]*$", "").alias("folder"))


SQL_JOB_IFRAMES = f"""
select page_id as listing_id, 0 as pos, {SITE_SQL} || '/careers/' as folder from pages
union all select page_id, 1, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') from pages"""

# --- detail pages -----------------------------------------------------------------------------

CHROME_BEFORE = (
    '<div id="cookieBar">We use cookies</div><div style="display: none">gone</div><div id="ASBreadcrumbs">a &gt; b</div>'
    '<section><h3>Similar jobs</h3><ul><li>Other job</li></ul></section><div class="btn-row"><a class="x">Apply now</a></div>'
)
CHROME_AFTER = '<div><button>Refer to a friend!</button></div><p>&nbsp;</p>'


def _with_chrome(spark, d):
    html = F.replace("html", F.lit("<article>"), F.lit(CHROME_BEFORE + "<article>"))
    return pages(spark, d, spread=True).withColumn("html", F.replace(html, F.lit("<footer>"), F.lit(CHROME_AFTER + "<footer>")))


def q_job_text(spark, d):
    """The chrome put into every page is gone again, all other text stays."""
    return P.job_text(_with_chrome(spark, d)).select("page_id", "job_text")


SQL_JOB_TEXT = f"select page_id, array_to_string({_pieces_sql('html')}, chr(10)) as job_text from pages"


def q_detail_html(spark, d):
    return P.detail_html(_with_chrome(spark, d)).select("page_id", "html_content")


def q_detail_text(spark, d):
    """The text inside the cleaned html: the main part without the chrome put in, nothing lost."""
    text = F.regexp_replace("html_content", "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return P.detail_html(_with_chrome(spark, d)).select("page_id", F.regexp_replace(text, r"(?U)\s+", "").alias("letters"))


LETTERS_SQL = f"regexp_replace(array_to_string({_pieces_sql(_BODY_SQL)}, ''), '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', '', 'g')"
SQL_DETAIL_TEXT = f"select page_id, {LETTERS_SQL} as letters from pages"

# --- company pages ----------------------------------------------------------------------------


def _company_html():
    number = F.col("page_id").cast("string")
    blocks = F.concat(
        F.lit('<div class="logobox"><img src="/logo-'), number, F.lit('.png"></div><div id="middle2"><h1 class="bold">Firm&nbsp; '), number,
        F.lit('</h1><div class="n-anons x"><img src="hero.png">Maker <b>of '), number, F.lit('</b></div></div>'),
        F.lit('<div class="sectionBlock"><p class="tlt"><a href="s/'), number, F.lit('">Part '), number,
        F.lit('</a></p><img src="//cdn.example.com/i.png"></div><div class="section-block"> </div><div class="sectionBlock"><i class="button"><a href="/b">go</a></i></div>'),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<div class="contacts-box"><strong>North '), number, F.lit(
            '</strong><p>Main Road 5</p><p>Vaughan ON L4K 1A1</p><div class="locationcontact">Contacts:<br>Ann Lee Tel:<br>555-9<br>ann@x.com</div>'
            '<p>Fax:</p><p>555-2</p></div>')))
        .when(F.col("page_id") % 3 == 1, F.lit('<table><tr><th>Phone</th><td>123</td></tr><tr><td>City</td><td>Oslo</td></tr><tr><td>city</td><td>Bergen</td></tr></table>'))
        .otherwise(F.concat(F.lit('<div class="office"><div id="contact-card"><b>Plant '), number, F.lit(
            '</b><br>1 Main St<br>Reno, NV 89501<br>Phone:<br>555-1<br><a href="mailto:o@x.com?s=1">write</a></div></div>'))),
        F.lit("<article>"),
    )
    html = F.replace("html", F.lit("<nav>"), F.lit('<nav class="tags">'))
    return _put_in(html, blocks)


def _companies(spark, d):
    return pages(spark, d, spread=True).withColumn("html", _company_html())


_FOLDER_SQL = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '')"
_SCHEME_SQL = "regexp_extract(url, '^[a-z]+:')"


def q_company_home(spark, d):
    home = M.company_home(_companies(spark, d))
    section = F.transform("sections", lambda s: F.concat_ws("|", F.coalesce(s["title"], F.lit("-")), F.coalesce(s["image"], F.lit("-")), s["url"]))
    return home.select(
        "page_id", "company_logo", "company_name", "hero_image", "description", F.array_join("tags", "|").alias("tags"), F.array_join(section, " ").alias("sections")
    )


SQL_COMPANY_HOME = f"""
with a as (select *, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) as ts from pages),
t as (select page_id, i, replace(trim(ts[i]), '&amp;', '&') as tag from a, unnest(range(1, len(ts) + 1)) as u(i)),
f as (select page_id, arg_min(tag, i) as tag, min(i) as i from t where tag <> '' and lower(tag) <> 'tags' group by page_id, lower(tag)),
g as (select page_id, string_agg(tag, '|' order by i) as tags from f group by page_id)
select a.page_id, {SITE_SQL} || '/logo-' || a.page_id || '.png' as company_logo, 'Firm ' || a.page_id as company_name, {_FOLDER_SQL} || 'hero.png' as hero_image,
  'Maker of ' || a.page_id as description, coalesce(tags, '') as tags,
  'Part ' || a.page_id || '|' || {_SCHEME_SQL} || '//cdn.example.com/i.png|' || {_FOLDER_SQL} || 's/' || a.page_id || ' -|-|' || {SITE_SQL} || '/b' as sections
from a left join g on g.page_id = a.page_id"""


def q_company_about(spark, d):
    about = M.company_about(_companies(spark, d))
    return about.select("page_id", F.array_join("images", "|").alias("images"), "description")


SQL_COMPANY_ABOUT = f"""
select page_id, {_FOLDER_SQL} || 'hero.png' as images, 'Maker of ' || page_id as description from pages"""


def q_contact_records(spark, d):
    contacts = C.contact_records(_companies(spark, d))
    person = F.col("contact_person")
    return contacts.select(
        "page_id", "name", "address", "city", "state", "post_code", "country", "phone", "telephone", "fax", "mail",
        person["name"].alias("person_name"), person["telephone"].alias("person_telephone"), person["email"].alias("person_email"),
    )


SQL_CONTACT_RECORDS = """
select page_id, case page_id % 3 when 0 then 'North ' || page_id when 2 then 'Plant ' || page_id end as name,
  case page_id % 3 when 0 then 'Main Road 5' when 2 then '1 Main St, write' end as address,
  case page_id % 3 when 0 then 'Vaughan' when 1 then 'Bergen' else 'Reno' end as city,
  case page_id % 3 when 0 then 'ON' when 2 then 'NV' end as state, case page_id % 3 when 0 then 'L4K 1A1' when 2 then '89501' end as post_code,
  cast(null as varchar) as country, case page_id % 3 when 1 then '123' when 2 then '555-1' end as phone, cast(null as varchar) as telephone,
  case page_id % 3 when 0 then '555-2' end as fax, case page_id % 3 when 2 then 'o@x.com' end as mail,
  case page_id % 3 when 0 then 'Ann Lee' end as person_name, case page_id % 3 when 0 then '555-9' end as person_telephone,
  case page_id % 3 when 0 then 'ann@x.com' end as person_email from pages"""


def q_company_profile(spark, d):
    p = _companies(spark, d)
    companies = p.select(
        F.col("page_id").alias("company_id"), F.col("url").alias("home_url"), F.col("html").alias("home_html"), F.col("url").alias("about_url"),
        F.col("html").alias("about_html"), F.lit("").alias("contact_url"), F.lit(None).cast("string").alias("contact_html"),
        F.when(F.col("page_id") % 2 == 0, F.lit('{"description":"From  model"}')).alias("about_response"),
        F.when(F.col("page_id") % 5 == 0, F.lit('{"regions":[{"name":"  HQ, ","phone":"1"},{"name":""}]}')).alias("contact_response"),
    )
    profile = M.company_profile(companies)
    return profile.select(
        "company_id", "home.company_name", F.col("about.description").alias("about"), F.size("regions").cast("bigint").alias("contacts"),
        F.get("regions", F.lit(0))["name"].alias("first_contact"), F.size("home.sections").cast("bigint").alias("sections"),
    )


SQL_COMPANY_PROFILE = """
select page_id as company_id, 'Firm ' || page_id as company_name, case when page_id % 2 = 0 then 'From model' else 'Maker of ' || page_id end as about,
  1 as contacts, case when page_id % 5 = 0 then 'HQ' when page_id % 3 = 0 then 'North ' || page_id when page_id % 3 = 2 then 'Plant ' || page_id end as first_contact,
  2 as sections from pages"""

def _company_model():
    """A stand-in for a model: the number in the page's address decides what it says about the company and its offices."""
    import json
    import re

    def answer(prompt: str) -> str:
        number = int(re.search(r"Page: \S*?/(\d+)", prompt).group(1))
        if "regions" in prompt.split("Page: ")[0]:
            return json.dumps({"regions": [{"name": f" HQ {number}, ", "phone": "1"}, {"name": ""}]}) if number % 2 else "no offices"
        if number % 3 == 0:
            raise RuntimeError("no answer")
        return json.dumps({"description": None if number % 3 == 1 else f"Text  {number}"})

    return answer


def q_company_model(spark, d):
    companies = _companies(spark, d).select(
        F.col("page_id").alias("company_id"), F.col("url").alias("home_url"), F.col("html").alias("home_html"), F.col("url").alias("about_url"),
        F.col("html").alias("about_html"), F.lit("").alias("contact_url"), F.lit(None).cast("string").alias("contact_html"),
    )
    profile = profiles_with_model(companies, _company_model)
    return profile.select(
        "company_id", "home.company_name", F.col("about.description").alias("about"), F.size("regions").cast("bigint").alias("contacts"),
        F.get("regions", F.lit(0))["name"].alias("first_contact"), F.get("regions", F.lit(0))["phone"].alias("first_phone"),
    )


SQL_COMPANY_MODEL = r"""
with n as (select page_id, cast(regexp_extract(url, '/(\d+)', 1) as bigint) as k from pages)
select page_id as company_id, 'Firm ' || page_id as company_name,
  case k % 3 when 0 then 'Maker of ' || page_id when 2 then 'Text ' || k end as about, 1 as contacts,
  case when k % 2 = 1 then 'HQ ' || k when page_id % 3 = 0 then 'North ' || page_id when page_id % 3 = 2 then 'Plant ' || page_id end as first_contact,
  case when k % 2 = 1 then '1' when page_id % 3 = 1 then '123' when page_id % 3 = 2 then '555-1' end as first_phone from n"""

_NAMES = [
    "company_model", "node_tags", "page_text", "main_content", "job_links", "abs_links", "links_outside_footer", "page_urls", "job_iframes", "job_text", "detail_text",
    "company_home", "company_about", "contact_records", "company_profile",
]
QUERIES = {f"q_{name}": globals()[f"q_{name}"] for name in [*_NAMES, "html_nodes", "detail_html"]}
ORACLES = {f"q_{name}": globals()[f"SQL_{name.upper()}"] for name in _NAMES}
