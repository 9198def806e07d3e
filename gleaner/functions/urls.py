"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.text import blank_to_null, strip_space

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*:)"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_HOST_BRACKET = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*[\[\]]"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_IPV6_HOST = r"^([^\[\]]*@)?\[[0-9A-Fa-f:.]+\](:\d*)?$"


def percent_decode(value: Column) -> Column:
    """Percent-decode, plus signs kept; text that does not decode stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY, 1)


def url_key(url: Column) -> Column:
    """Identity of a page: no query, no fragment, but the opportunity id where the path asks for one."""
    text = F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")
    authority = F.regexp_extract(text, _AUTHORITY, 1)
    broken = text.rlike(_HOST_BRACKET) & ~authority.rlike(_IPV6_HOST)
    plain = F.regexp_replace(text, r"(?s)[?#].*$", "")
    scheme = F.regexp_extract(text, _SCHEME, 1)
    lowered = F.concat(F.lower(scheme), F.substring(plain, F.length(scheme) + 1, F.length(plain)))
    page = F.when(text.rlike(r"^[A-Za-z0-9+.\-]*[A-Z][A-Za-z0-9+.\-]*:"), lowered).otherwise(plain)
    query = F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1)
    opportunity = blank_to_null(F.regexp_extract(query, r"(?:^|&)opportunityId=([^&]+)", 1))
    decoded = F.coalesce(F.try_url_decode(opportunity), opportunity)
    named = F.contains(text, F.lit("OpportunityDetail"))
    detail = named & F.contains(F.regexp_extract(text, _PATH, 1), F.lit("OpportunityDetail")) & decoded.isNotNull()
    return (
        F.when(broken, F.regexp_replace(url, r"(?s)[?#].*$", ""))
        .when(detail, F.concat(page, F.lit("?opportunityId="), decoded))
        .otherwise(page)
    )


def is_job_url(url: Column) -> Column:
    return F.lower(url).rlike("|".join(K.JOB_URL_PATTERNS + K.JOB_URL_WORDS))


def valid_url(url: Column) -> Column:
    """Not blank, and an absolute URL: web schemes need a host, other schemes only a name."""
    text = strip_space(F.coalesce(url, F.lit("")))
    web = r"(?i)^(?:https?|wss?|ftp):"
    host = web + r"[/\\]*(?:[^/\\?#@]*@)?(?:\[[0-9a-f:.]+\]|[^\s/\\?#:@<>^|%\[\]]+)(?::\d{0,5})?(?:[/\\?#].*)?$"
    return text.rlike(host) | (text.rlike(_SCHEME) & ~text.rlike(web))


def is_valid_link(text: Column, href: Column) -> Column:
    """Not a navigation link, and its text says something."""
    label = F.lower(strip_space(text))
    words = "|".join(K.NAVIGATION_WORDS)
    return ~(
        label.rlike(words)
        | F.lower(F.coalesce(href, F.lit(""))).rlike(words)
        | (F.length(label) < 3)
        | label.isin(K.GENERIC_LINK_TEXTS)
    )


def absolute_url(base: Column, ref: Column) -> Column:
    """Resolve a reference against a base URL."""
    scheme = F.regexp_extract(base, _SCHEME, 1)
    root = F.concat(scheme, F.lit("//"), F.regexp_extract(base, _AUTHORITY, 1))
    base_path = F.regexp_extract(base, _PATH, 1)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    ref_rest = F.substring(ref, F.length(ref_path) + 1, F.length(ref))
    base_query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    joined = F.when(F.startswith(ref_path, F.lit("/")), ref_path).otherwise(
        F.concat(F.regexp_replace(base_path, r"[^/]*$", ""), ref_path)
    )
    joined = F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))
    segments = F.split(F.substring(joined, F.lit(2), F.length(joined)), "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part == ".", done)
        .otherwise(F.array_append(done, part)),
    )
    tail = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    resolved = F.concat(root, F.lit("/"), F.array_join(kept, "/"), tail)
    plain = ~joined.rlike(r"/\.{1,2}(/|$)")
    return (
        F.when(ref == "", base)
        .when(ref.rlike(_SCHEME), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme, ref))
        .when(ref_path == "", F.concat(root, base_path, F.when(F.startswith(ref, F.lit("?")), F.lit("")).otherwise(base_query), ref_rest))
        .when(plain, F.concat(root, joined, ref_rest))
        .otherwise(F.concat(resolved, ref_rest))
    )


def _trim_tail(url: Column) -> Column:
    return F.rtrim(url, F.lit(K.URL_TAIL_CHARS))


def detail_urls(html: Column, base: Column) -> Column:
    """Detail URLs named anywhere in the html, in the order the passes find them, each once."""

    def found(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), group)

    def quoted(pattern: str) -> Column:
        return F.transform(found(pattern, 1), lambda ref: absolute_url(base, strip_space(ref)))

    escaped = F.transform(
        found(K.DETAIL_ESCAPED, 0),
        lambda url: _trim_tail(F.replace(F.replace(url, F.lit("\\/"), F.lit("/")), F.lit("\\\\"), F.lit("\\"))),
    )
    return F.array_distinct(
        F.concat(
            F.transform(found(K.DETAIL_ABSOLUTE, 0), _trim_tail),
            quoted(K.DETAIL_QUOTED),
            F.transform(found(K.DETAIL_CAREERS, 0), _trim_tail),
            escaped,
            F.transform(found(K.DETAIL_BOARD, 0), _trim_tail),
            quoted(K.DETAIL_BOARD_QUOTED),
        )
    )


def detail_url_filter(urls: Column) -> Column:
    """Keep the URLs that carry a detail number or an opportunity id."""
    return F.filter(urls, lambda url: url.rlike(K.DETAIL_NUMBER) | url.rlike(K.DETAIL_OPPORTUNITY))


def embedded_listing_url(landing: Column, domain: Column, code: Column, portal: Column) -> Column:
    """Address of the listing behind an embedding page, NULL where nothing names it."""
    raw = blank_to_null(F.regexp_extract(landing, r"^[^?#]*\?(?:[^#]*?&)?cxembeddedroot=([^&#]+)", 1))
    path = percent_decode(F.coalesce(F.try_url_decode(raw), raw))
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    joiner = F.when(F.contains(path, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    path = F.when(F.contains(F.lower(path), F.lit("embedded=true")), path).otherwise(
        F.concat(path, joiner, F.lit("embedded=true"))
    )
    code, portal = blank_to_null(strip_space(code)), blank_to_null(strip_space(portal))
    built = F.concat(domain, F.lit("/"), code, F.lit("/"), portal, F.lit("?embedded=true"))
    return F.coalesce(F.concat(domain, F.regexp_replace(path, "(?s)#.*$", "")), built)


def numbered_page_urls(base: Column, last_page: int = 10) -> Column:
    """Guessed addresses of the pages after the first."""
    return F.transform(
        F.sequence(F.lit(2), F.lit(last_page)), lambda page: F.concat(base, F.lit("?page="), page.cast("string"))
    )


def mailto_address(href: Column) -> Column:
    return strip_space(F.split_part(F.replace(href, F.lit("mailto:"), F.lit("")), F.lit("?"), F.lit(1)))


def tag_from_href(href: Column) -> Column:
    """Last path segment, decoded; NULL when there is none."""
    path = F.regexp_extract(href, _PATH, 1)
    segment = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return blank_to_null(strip_space(percent_decode(segment)))


def page_slug(url: Column) -> Column:
    """File-safe name of a page."""
    bare = F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.regexp_replace(bare, r"(?U)[^\w\-_.]", "_")
