"""Company profiles with a model's reading of the about and contact pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.markup import parse_nodes
from gleaner.functions.records import extract_with_model
from gleaner.functions.staging import settled
from gleaner.functions.text import strip_space
from gleaner.operators.company import company_profile
from gleaner.operators.pages import page_lines
from gleaner.session import cut_lineage

ASK_ABOUT = (
    "The text below comes from a company's own page. Answer with a JSON object that has one key, description: the company's account "
    "of itself, word for word and with its line breaks, or null where there is none.\n"
)
ASK_CONTACTS = (
    "The text below comes from a company's contact page. Answer with a JSON object that has one key, regions: a list with one object for each "
    f"office or region, with the keys {', '.join(K.CONTACT_FIELDS)} and contact_person, all null where the page does not say.\n"
)


def _prompt(ask: str, url: Column, text: Column) -> Column:
    """The question about a page with its whole text; NULL where it has none, so that nothing is asked."""
    return F.when(strip_space(text) != "", F.concat(F.lit(ask + "Page: "), F.coalesce(url, F.lit("")), F.lit("\nText:\n"), text))


def ask_company_pages(companies: DataFrame, open_model: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Add ``about_response`` and ``contact_response``, asked once per company and written to the checkpoint folder.

    Takes the columns of ``company_profile``. Without a contact URL the home page is asked for contacts.
    """
    has_contact = strip_space(F.coalesce("contact_url", F.lit(""))) != ""
    contact_url = F.when(has_contact, strip_space(F.col("contact_url"))).otherwise(F.col("home_url"))
    contact_html = F.when(has_contact, F.col("contact_html")).otherwise(F.col("home_html"))
    read = companies.withColumns({"_about": parse_nodes(F.col("about_html"), F.col("about_url"), use_base=True), "_contact": parse_nodes(contact_html, contact_url, use_base=True)})
    shown = settled(read, {name: F.array_join(page_lines(F.col(nodes)), "\n") for name, nodes in (("_about_text", "_about"), ("_contact_text", "_contact"))})
    asked = shown.withColumns({"_ask_about": _prompt(ASK_ABOUT, F.col("about_url"), F.col("_about_text")), "_ask_contact": _prompt(ASK_CONTACTS, contact_url, F.col("_contact_text"))})
    slim = asked.select(*companies.columns, "_ask_about", "_ask_contact")
    answered = extract_with_model(extract_with_model(slim, open_model, "_ask_about", "about_response"), open_model, "_ask_contact", "contact_response")
    return cut_lineage(answered.drop("_ask_about", "_ask_contact"))


def profiles_with_model(companies: DataFrame, open_model: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Nested profiles; what the model gave replaces the rules' description and contacts, see ``company_profile``."""
    return company_profile(ask_company_pages(companies, open_model))
