"""Contact records: from lines of text blocks, and from whole pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.contacts import (
    PERSON,
    address_fields,
    complete_contact,
    contact_label,
    first_labeled,
    has_contact_data,
    has_contact_signal,
    heading_line,
    last_per_label,
    line_facts,
    pair_label_lines,
    person_fields,
    tidy_lines,
)
from gleaner.functions.nodes import (
    attr,
    clean_lines,
    clean_text,
    descendants,
    find,
    find_all,
    has_class,
    id_and_class,
    is_element,
    remove,
)
from gleaner.functions.text import blank_to_null, let, strip_space
from gleaner.functions.urls import mailto_address
from gleaner.operators.pages import SILENT_TAGS, lowest_matching, middle_block, parse_pages
from gleaner.functions.staging import settled, spread_struct

CONTACT = "struct<" + ",".join(f"{name}:string" for name in K.CONTACT_FIELDS) + f",contact_person:{PERSON}>"


def read_contacts(df: DataFrame, lines: str = "lines", out: str = "contact") -> DataFrame:
    """Add the struct of contact fields that the lines of each row's text block spell out.

    Labelled lines come first. Of the other lines, the first email is the mail unless a label gave one
    before; the first line that reads like a heading is the name; places fill the address fields.
    """
    facts = settled(df, {"_facts": line_facts(pair_label_lines(tidy_lines(F.col(lines))))})
    # Flat columns only: nested fields read through several generators confuse the optimizer.
    labels = {key: first_labeled(F.col("_facts"), key) for key, _ in K.LABEL_PATTERNS}
    free = F.filter(
        "_facts", lambda f: ~f["skipped"] & f["labeled"].isNull() & ~F.endswith(f["line"], F.lit(":"))
    )
    first_email = F.get(F.filter(free, lambda f: f["email"].isNotNull()), F.lit(0))
    found = settled(
        facts,
        {
            "_free": free,
            "_mail_at": labels["mail"]["i"],
            "_email": first_email["email"],
            "_email_at": first_email["i"],
            **{f"_label_{key}": found["value"] for key, found in labels.items()},
        },
    ).drop("_facts")

    email_wins = F.col("_email").isNotNull() & (F.col("_mail_at").isNull() | (F.col("_email_at") < F.col("_mail_at")))
    found = settled(
        found,
        {
            "_mail": F.when(email_wins, F.col("_email")).otherwise(F.col("_label_mail")),
            "_taken": F.when(email_wins, F.col("_email_at")),
        },
    )
    rest = F.transform(
        "_free",
        lambda f: F.when(
            f["i"] == F.col("_taken"), F.btrim(F.replace(f["line"], f["email"], F.lit("")), F.lit(" :-"))
        ).otherwise(f["line"]),
    )
    lined = settled(found, {"_rest": F.filter(rest, lambda line: line != "")})
    named = settled(lined, {"_heading": F.when(F.col("_label_name").isNull(), heading_line(F.col("_rest")))})
    body = F.when(F.col("_heading").isNull(), F.col("_rest")).otherwise(
        F.filter("_rest", lambda line: line != F.col("_heading"))
    )
    named = settled(named, {"_rest": body, "_name": F.coalesce("_label_name", "_heading")})

    label = lambda key: F.col(f"_label_{key}")
    place = address_fields(F.col("_rest"), F.col("_name"), label("country"), label("post_code"), label("city"), label("state"))
    place_names = [f"_place_{name}" for name in ("country", "post_code", "city", "state", "lines")]
    types = ["string"] * 4 + ["array<string>"]
    flat = "struct<" + ",".join(f"{name}:{kind}" for name, kind in zip(place_names, types)) + ">"
    placed = spread_struct(named, place.cast(flat), place_names)
    contact = F.struct(
        F.col("_name").alias("name"),
        F.coalesce(label("address"), blank_to_null(F.array_join("_place_lines", ", "))).alias("address"),
        *[F.col(f"_place_{name}").alias(name) for name in ("city", "post_code", "state", "country")],
        *[label(name).alias(name) for name in ("telephone", "phone", "fax")],
        F.col("_mail").alias("mail"),
    )
    return placed.select(*df.columns, contact.alias(out))


# --- blocks of a page ---------------------------------------------------------------------------

BLOCK = (
    "struct<kind:int,lines:array<string>,heading:string,mailto:string,person_lines:array<string>,"
    "labels:array<string>,values:array<string>>"
)
BOX, TABLE, PLAIN = 0, 1, 2


def _block(kind: int, **fields: Column) -> Column:
    names = ("lines", "heading", "mailto", "person_lines", "labels", "values")
    given = [fields.get(name, F.lit(None)).alias(name) for name in names]
    return F.struct(F.lit(kind).alias("kind"), *given).cast(BLOCK)


def _boxes(page: Column) -> Column:
    """Marked contact boxes; a nested block describes the person."""

    def of_box(box: Column) -> Column:
        body = descendants(page, box)
        person = find(body, lambda n: has_class(n, "locationcontact"))
        rest = remove(body, lambda n: has_class(n, "locationcontact"))

        def of_rest(kept: Column) -> Column:
            strong = find(kept, lambda n: n["tag"] == "strong")
            text = let(
                strong,
                lambda s: clean_text(F.filter(kept, lambda n: (n["node"] > s["node"]) & (n["node"] <= s["last"]))),
            )
            return _block(BOX, lines=clean_lines(kept), heading=text, person_lines=clean_lines(descendants(page, person)))

        return let(rest, of_rest)

    return F.transform(find_all(page, lambda n: has_class(n, "contacts-box")), of_box)


def _tables(page: Column) -> Column:
    """Tables as pairs of a first and a second cell."""

    def of_table(table: Column) -> Column:
        def of_row(row: Column) -> Column:
            cells = find_all(
                descendants(page, row), lambda n: n["tag"].isin("th", "td") & (n["parent"] == row["node"])
            )
            return F.filter(F.transform(cells, lambda c: clean_text(descendants(page, c))), lambda t: t.isNotNull())

        rows = F.transform(find_all(descendants(page, table), lambda n: n["tag"] == "tr"), of_row)
        pairs = F.filter(rows, lambda texts: F.size(texts) >= 2)
        first = F.transform(pairs, lambda texts: F.get(texts, F.lit(0)))
        second = F.transform(pairs, lambda texts: F.get(texts, F.lit(1)))
        return _block(TABLE, labels=first, values=second)

    return F.transform(find_all(page, lambda n: n["tag"] == "table"), of_table)


def _plain_blocks(page: Column, named: Column, main: Column) -> Column:
    """Blocks named like contacts, lowest level; the main block when there are none."""

    def of_block(block: Column) -> Column:
        body = descendants(page, block)
        link = find(body, lambda n: (n["tag"] == "a") & F.startswith(attr(n, "href"), F.lit("mailto:")))
        return _block(PLAIN, lines=clean_lines(body), mailto=mailto_address(strip_space(attr(link, "href"))))

    fallback = F.filter(F.array(main), lambda block: block.isNotNull())
    blocks = F.when(F.size(named) > 0, lowest_matching(named)).otherwise(fallback)
    return F.transform(blocks, of_block)


def _has_person(person: Column) -> Column:
    return F.coalesce(*[blank_to_null(person[name]) for name in K.PERSON_FIELDS]).isNotNull()


def contacts_by_page(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``contacts`` per page: those of boxes, or else of tables and blocks, each once, in page order.

    The blocks of a page are read as rows. Only the short contact structs are grouped again by page.
    """
    quiet = remove(F.col("nodes"), lambda n: n["tag"].isin(*SILENT_TAGS))
    page = settled(parse_pages(pages, use_base=True).select(key, "nodes"), {"nodes": quiet})
    named = find_all(
        F.col("nodes"),
        lambda n: is_element(n)
        & id_and_class(n).rlike(K.CONTACT_BLOCK_NAMES)
        & has_contact_signal(clean_text(descendants(F.col("nodes"), n))),
    )
    main = F.coalesce(
        middle_block(F.col("nodes")),
        find(F.col("nodes"), lambda n: n["tag"] == "main"),
        find(F.col("nodes"), lambda n: n["tag"] == "body"),
    )
    page = settled(page, {"_named": named, "_main": main})
    nodes = F.col("nodes")
    listed = F.concat(_boxes(nodes), _tables(nodes), _plain_blocks(nodes, F.col("_named"), F.col("_main")))
    blocks = page.select(key, F.posexplode(listed).alias("pos", "block")).select(key, "pos", "block.*")

    nothing = F.array().cast("array<string>")
    lined = blocks.withColumns(
        {"lines": F.coalesce("lines", nothing), "labels": F.transform("labels", lambda text: contact_label(text))}
    )
    person = F.when(F.col("kind") == BOX, person_fields(F.coalesce("person_lines", nothing)))
    person_names = [f"_person_{name}" for name in K.PERSON_FIELDS]
    flat = "struct<" + ",".join(f"{name}:string" for name in person_names) + ">"
    read = spread_struct(read_contacts(lined), F.coalesce(person.cast(flat), F.lit(None).cast(flat)), person_names)
    read = read.withColumn("_person", F.struct(*[F.col(f"_person_{name}").alias(name) for name in K.PERSON_FIELDS]))
    table = F.struct(*[last_per_label(F.col("labels"), F.col("values"), name).alias(name) for name in K.CONTACT_FIELDS])
    heading = F.when(
        (F.btrim(F.lower("heading"), F.lit(":")) != "contacts") & ~F.endswith("heading", F.lit(":")), F.col("heading")
    )
    chosen = (
        F.when(F.col("kind") == TABLE, table)
        .when(F.col("kind") == BOX, F.col("contact").withField("name", F.coalesce(heading, F.col("contact.name"))))
        .otherwise(F.col("contact").withField("mail", F.coalesce("contact.mail", blank_to_null(F.col("mailto")))))
    )
    held = read.withColumn("contact", chosen)
    data = has_contact_data(F.col("contact"))
    kept = held.filter(
        F.when(F.col("kind") == BOX, data | F.col("contact.name").isNotNull() | _has_person(F.col("_person")))
        .when(F.col("kind") == TABLE, data | F.array_contains("labels", "contact_person"))
        .otherwise(data & has_contact_signal(F.array_join("lines", "\n")))
    )
    done = kept.select(key, "pos", "kind", complete_contact(F.col("contact"), F.col("_person")).alias("contact"))
    filled = F.coalesce(*[F.col(f"contact.{name}") for name in K.CONTACT_FIELDS]).isNotNull()
    done = done.filter(filled | F.col("contact.contact_person").isNotNull())
    grouped = done.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("pos", "kind", "contact"))).alias("_all"), F.min("kind").alias("_first_kind")
    )
    preferred = F.filter("_all", lambda c: (c["kind"] == BOX) | (F.col("_first_kind") != BOX))
    return grouped.select(key, F.array_distinct(F.transform(preferred, lambda c: c["contact"])).alias("contacts"))


def contact_records(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per contact of a page, in page order."""
    rows = contacts_by_page(pages, key).select(key, F.posexplode("contacts").alias("pos", "contact"))
    return rows.select(key, "pos", "contact.*")
