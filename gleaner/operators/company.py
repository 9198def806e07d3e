"""Company profiles: home, about and contact pages of a company in one nested row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.contacts import complete_contact
from gleaner.functions.markup import parse_nodes
from gleaner.functions.records import verbatim_or_rule
from gleaner.functions.text import blank_to_null, strip_code_fence, strip_space
from gleaner.operators.contacts import CONTACT, contacts_by_page
from gleaner.operators.pages import (
    company_about_fields,
    company_home_fields,
    company_sections,
    company_tags,
    parse_pages,
)


def company_home(pages: DataFrame, key: str = "page_id") -> DataFrame:
    nodes = F.col("nodes")
    return parse_pages(pages, use_base=True).select(
        key,
        company_home_fields(nodes).alias("home"),
        company_tags(nodes).alias("tags"),
        company_sections(nodes).alias("sections"),
    ).select(key, "home.*", "tags", "sections")


def company_about(pages: DataFrame, key: str = "page_id") -> DataFrame:
    about = company_about_fields(F.col("nodes"))
    return parse_pages(pages, use_base=True).select(key, about.alias("about")).select(key, "about.*")


def regions_or_rule(response: Column, rule: Column) -> Column:
    """The model's contacts with some content, else the rule-based contacts."""
    text = strip_code_fence(response)
    answered = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), "$.regions", "variant"))
    regions = F.from_json(text, f"struct<regions:array<{CONTACT}>>")["regions"]
    kept = F.filter(
        regions,
        lambda c: F.coalesce(*[blank_to_null(c[name]) for name in K.CONTACT_FIELDS]).isNotNull()
        | c["contact_person"].isNotNull(),
    )
    tidied = F.transform(kept, lambda c: complete_contact(c, c["contact_person"]))
    return F.when(F.startswith(answered, F.lit("ARRAY")), tidied).otherwise(rule)


def company_profile(companies: DataFrame) -> DataFrame:
    """Nested profile per company.

    ``companies`` has one row per company: ``company_id`` and, for each of ``home``, ``about`` and
    ``contact``, the ``*_url`` and ``*_html`` of the fetched page. Optional ``about_response`` and
    ``contact_response`` hold model answers. Without a contact URL the home page gives the contacts.
    The html is read and dropped before the short results meet in one join on the company.
    """
    has_contact = strip_space(F.coalesce("contact_url", F.lit(""))) != ""
    contact_pages = companies.select(
        "company_id",
        F.when(has_contact, strip_space(F.col("contact_url"))).otherwise(F.col("home_url")).alias("url"),
        F.when(has_contact, F.col("contact_html")).otherwise(F.col("home_html")).alias("html"),
    )
    answers = [name for name in ("about_response", "contact_response") if name in companies.columns]
    nodes = companies.select(
        "company_id",
        *answers,
        parse_nodes(F.col("home_html"), F.col("home_url"), use_base=True).alias("_home"),
        parse_nodes(F.col("about_html"), F.col("about_url"), use_base=True).alias("_about"),
    )
    read = nodes.select(
        "company_id",
        *answers,
        company_home_fields(F.col("_home")).alias("home"),
        company_tags(F.col("_home")).alias("tags"),
        company_sections(F.col("_home")).alias("sections"),
        company_about_fields(F.col("_about")).alias("about"),
    )
    joined = read.join(contacts_by_page(contact_pages, "company_id"), "company_id", "left")
    about, regions = F.col("about"), F.coalesce("contacts", F.array().cast(f"array<{CONTACT}>"))
    if "about_response" in answers:
        text = verbatim_or_rule(F.col("about_response"), F.col("about.description"))
        about = about.withField("description", text)
    if "contact_response" in answers:
        regions = regions_or_rule(F.col("contact_response"), regions)
    home = [F.col(f"home.{name}").alias(name) for name in ("company_logo", "company_name", "hero_image", "description")]
    return joined.select(
        "company_id", F.struct(*home, "tags", "sections").alias("home"), about.alias("about"), regions.alias("regions")
    )
