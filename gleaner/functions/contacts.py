"""Contact expressions over the lines of one text block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.text import blank_to_null, let, literal_map, normalize_space, strip_space


def _null() -> Column:
    return F.lit(None).cast("string")


def extract_email(text: Column) -> Column:
    found = blank_to_null(F.regexp_extract(text, f"(?U){K.EMAIL_PATTERN}", 0))
    return F.when(F.contains(text, F.lit("@")), found)


def looks_like_phone(text: Column) -> Column:
    return strip_space(text).rlike(f"(?U){K.PHONE_PATTERN}") & text.rlike(r"(?U)\d")


def has_contact_signal(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?U){K.CONTACT_SIGNAL}"), F.lit(False))


def contact_label(text: Column) -> Column:
    """Contact field named by a table heading, NULL for other headings."""
    snake = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    known = F.when(snake.isin(*K.CONTACT_FIELDS, "contact_person"), snake)
    return F.coalesce(F.try_element_at(literal_map(K.CONTACT_LABEL_ALIASES), snake), known)


def labeled_value(line: Column) -> Column:
    """Struct(key, value) of a line that starts with a label, NULL for other lines."""
    chosen = None
    for key, names in K.LABEL_PATTERNS:
        pattern = rf"(?iU)^(?:{names})\s*[:\-]?\s*(.+)$"
        found = F.struct(F.lit(key).alias("key"), strip_space(F.regexp_extract(line, pattern, 1)).alias("value"))
        chosen = F.when(line.rlike(pattern), found) if chosen is None else chosen.when(line.rlike(pattern), found)
    # One look at the start spares most lines the ten patterns.
    any_label = "|".join(names for _, names in K.LABEL_PATTERNS)
    return F.when(line.rlike(rf"(?iU)^(?:{any_label})"), chosen)


def pair_label_lines(lines: Column) -> Column:
    """Join every lone label with the line after it; that line is then used up.

    One left-to-right replacement does it: a match swallows the following line, so a label that was
    swallowed cannot start a match of its own.
    """
    labels = "|".join(K.PAIRED_LABELS)
    text = F.regexp_replace(F.array_join(lines, "\n"), rf"(?imd)^(:*(?:{labels}):*)\n(.*)$", "$1 $2")
    return F.when(F.size(lines) == 0, lines).otherwise(F.split(text, "\n"))


def is_canadian_post_code(line: Column) -> Column:
    return strip_space(line).rlike(f"(?U){K.CANADIAN_POST_CODE}")


def parse_city_state_post(line: Column) -> Column:
    """Struct(city, state, post_code) of "City ST A1A 1A1" or "City, ST 12345", else NULL."""
    canada, us = f"(?U){K.CITY_LINE_CANADA}", f"(?U){K.CITY_LINE_US}"

    def parts(city: Column, state: Column, post_code: Column) -> Column:
        return F.struct(city.alias("city"), F.upper(state).alias("state"), post_code.alias("post_code"))

    def group(pattern: str, number: int) -> Column:
        return F.regexp_extract(strip_space(line), pattern, number)

    found = F.when(
        strip_space(line).rlike(canada),
        parts(F.btrim(group(canada, 1), F.lit(", ")), group(canada, 2), F.upper(group(canada, 3))),
    ).when(strip_space(line).rlike(us), parts(strip_space(group(us, 1)), group(us, 2), group(us, 3)))
    # Both layouts end in a digit.
    return F.when(line.rlike(r"(?U)\d\s*$"), found)


def parse_city_state_country(line: Column) -> Column:
    """Struct(city, state, country) of a line with exactly three comma parts, else NULL."""

    def three(parts: Column) -> Column:
        named = F.struct(*[F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(("city", "state", "country"))])
        return F.when(F.size(parts) == 3, named)

    parts = F.filter(F.transform(F.split(line, ","), strip_space), lambda part: part != "")
    return F.when(F.contains(line, F.lit(",")), let(parts, three))


def heading_line(lines: Column) -> Column:
    """First line that is no email, place or street address."""

    def is_heading(line: Column) -> Column:
        street = line.rlike(r"(?U)\d") & line.rlike(f"(?U){K.STREET_PATTERN}")
        return ~(
            extract_email(line).isNotNull()
            | parse_city_state_post(line).isNotNull()
            | F.lower(line).isin(K.COUNTRY_LINES)
            | street
        )

    return F.get(F.filter(lines, is_heading), F.lit(0))


ADDRESS_STATE = (
    "struct<country:string,post_code:string,city:string,state:string,country_at:int,post_at:int>"
)


def address_fields(
    lines: Column,
    name: Column | None = None,
    country: Column | None = None,
    post_code: Column | None = None,
    city: Column | None = None,
    state: Column | None = None,
) -> Column:
    """Read the lines in order: country, post code, place lines, and the rest as the address.

    What earlier lines filled decides how later lines are read, so this is a fold. The other
    arguments are values already known. ``address_lines`` holds the leftover lines: the fold notes which two lines gave
    country and post code, and the lines are filtered once.
    """
    known = lambda column: _null() if column is None else column
    start = F.struct(
        known(country).alias("country"),
        known(post_code).alias("post_code"),
        known(city).alias("city"),
        known(state).alias("state"),
        F.lit(-1).alias("country_at"),
        F.lit(-1).alias("post_at"),
    ).cast(ADDRESS_STATE)
    facts = F.transform(
        lines,
        lambda line, i: F.struct(
            i.alias("at"),
            line.alias("line"),
            F.lower(line).isin(K.COUNTRY_LINES).alias("is_country"),
            is_canadian_post_code(line).alias("is_post_code"),
            parse_city_state_country(line).alias("three"),
            parse_city_state_post(line).alias("place"),
            (F.lit(True) if name is None else ~line.eqNullSafe(name)).alias("other"),
        ),
    )

    def read(done: Column, fact: Column) -> Column:
        takes_country = done["country"].isNull() & fact["is_country"]
        takes_post = ~takes_country & done["post_code"].isNull() & fact["is_post_code"]
        free = ~takes_country & ~takes_post
        three, place = free & fact["three"].isNotNull(), free & fact["three"].isNull() & fact["place"].isNotNull()
        from_line = lambda field: F.when(three, fact["three"][field]).when(place, fact["place"][field])
        return F.struct(
            F.coalesce(done["country"], F.when(takes_country, fact["line"]).when(three, fact["three"]["country"])).alias("country"),
            F.coalesce(
                done["post_code"], F.when(takes_post, F.upper(fact["line"])).when(place, fact["place"]["post_code"])
            ).alias("post_code"),
            F.coalesce(done["city"], from_line("city")).alias("city"),
            F.coalesce(done["state"], from_line("state")).alias("state"),
            F.when(takes_country, fact["at"]).otherwise(done["country_at"]).alias("country_at"),
            F.when(takes_post, fact["at"]).otherwise(done["post_at"]).alias("post_at"),
        ).cast(ADDRESS_STATE)

    def with_lines(held: Column, done: Column) -> Column:
        taken = lambda fact: (fact["at"] == done["country_at"]) | (fact["at"] == done["post_at"])
        left = F.filter(held, lambda fact: ~taken(fact) & fact["three"].isNull() & fact["place"].isNull() & fact["other"])
        lines_left = F.transform(left, lambda fact: fact["line"])
        return F.struct(*[done[name].alias(name) for name in ("country", "post_code", "city", "state")], lines_left.alias("address_lines"))

    return let(facts, lambda held: let(F.aggregate(held, start, read), lambda done: with_lines(held, done)))


def _bare_label(line: Column) -> Column:
    return F.btrim(F.lower(line), F.lit(":"))


def line_facts(lines: Column) -> Column:
    """What each line says on its own, worked out once per line."""
    return F.transform(
        lines,
        lambda line, i: F.struct(
            i.alias("i"),
            line.alias("line"),
            _bare_label(line).isin(K.SKIPPED_LABELS).alias("skipped"),
            labeled_value(line).alias("labeled"),
            extract_email(line).alias("email"),
        ),
    )


def first_labeled(facts: Column, key: str) -> Column:
    """First non-empty value under a label, as struct(i, value)."""
    hits = F.filter(
        facts, lambda f: ~f["skipped"] & (f["labeled"]["key"] == key) & (f["labeled"]["value"] != "")
    )
    hit = F.get(hits, F.lit(0))
    return F.when(hit.isNotNull(), F.struct(hit["i"].alias("i"), hit["labeled"]["value"].alias("value")))


def last_per_label(labels: Column, values: Column, key: str) -> Column:
    """Last value among pairs of a table whose heading names the field."""
    pairs = F.filter(F.arrays_zip(labels.alias("label"), values.alias("value")), lambda p: p["label"] == key)
    return F.try_element_at(pairs, F.lit(-1))["value"]


def tidy_lines(lines: Column) -> Column:
    return F.filter(F.transform(lines, normalize_space), lambda line: line != "")


PERSON = "struct<name:string,email:string,phone:string,telephone:string,fax:string>"
_PERSON_STATE = f"struct<person:{PERSON},first_free:string,skip:boolean>"
_NAMED_LINE = r"(?iU)^(.+?)\s+(phone|telephone|tel|fax)\s*:\s*(.*)$"


def person_fields(lines: Column) -> Column:
    """Struct of a contact person; a lone label takes the next line as its value.

    Whether a line is a value depends on the line before, so this is a fold over the positions.
    """
    lines = pair_label_lines(F.filter(tidy_lines(lines), lambda line: ~_bare_label(line).isin("contacts", "contact")))

    def facts_of(all_lines: Column) -> Column:
        return F.transform(
            all_lines,
            lambda line, i: F.struct(
                line.alias("line"),
                F.get(all_lines, i + 1).alias("following"),
                line.rlike(_NAMED_LINE).alias("named"),
                strip_space(F.regexp_extract(line, _NAMED_LINE, 1)).alias("named_name"),
                F.lower(F.regexp_extract(line, _NAMED_LINE, 2)).alias("named_label"),
                strip_space(F.regexp_extract(line, _NAMED_LINE, 3)).alias("named_value"),
                _bare_label(line).alias("label"),
                labeled_value(line).alias("labeled"),
                extract_email(line).alias("email"),
            ),
        )

    def read(state: Column, f: Column) -> Column:
        has_next = f["following"].isNotNull()
        lone_key = (
            F.when(f["label"].isin("phone", "mobile", "cell"), "phone")
            .when(f["label"].isin("telephone", "tel"), "telephone")
            .when(f["label"] == "fax", "fax")
        )
        named = f["named"]
        lone = ~named & has_next & lone_key.isNotNull()
        labeled = ~named & ~lone & f["labeled"].isNotNull()
        free = ~named & ~lone & ~labeled
        named_key = (
            F.when(f["named_label"] == "fax", "fax")
            .when(f["named_label"].isin("telephone", "tel"), "telephone")
            .otherwise("phone")
        )
        named_value = F.coalesce(blank_to_null(f["named_value"]), f["following"])
        labeled_key = F.when(f["labeled"]["key"] == "mail", "email").otherwise(f["labeled"]["key"])
        key = F.when(named, named_key).when(lone, lone_key).when(labeled, labeled_key)
        value = (
            F.when(named, blank_to_null(named_value)).when(lone, f["following"]).when(labeled, f["labeled"]["value"])
        )
        rest = F.when(
            f["email"].isNotNull(), F.btrim(F.replace(f["line"], f["email"], F.lit("")), F.lit(" :-"))
        ).otherwise(f["line"])
        old = state["person"]

        def field(name: str) -> Column:
            kept = F.coalesce(F.when(key == name, value), old[name])
            if name == "email":
                return F.when(free & f["email"].isNotNull(), f["email"]).otherwise(kept)
            if name == "name":
                return F.when(named, F.coalesce(blank_to_null(old["name"]), blank_to_null(f["named_name"]))).otherwise(kept)
            return kept

        first_free = F.coalesce(
            state["first_free"], F.when(free & (rest != "") & ~looks_like_phone(rest), rest)
        )
        takes_next = lone | (named & (f["named_value"] == "") & has_next)
        advanced = F.struct(
            F.struct(*[field(name).alias(name) for name in K.PERSON_FIELDS]).alias("person"),
            first_free.alias("first_free"),
            takes_next.alias("skip"),
        ).cast(_PERSON_STATE)
        skipped = state.withField("skip", F.lit(False)).cast(_PERSON_STATE)
        return F.when(state["skip"], skipped).otherwise(advanced)

    start = F.struct(
        F.struct(*[_null().alias(name) for name in K.PERSON_FIELDS]).alias("person"),
        _null().alias("first_free"),
        F.lit(False).alias("skip"),
    ).cast(_PERSON_STATE)
    folded = let(lines, lambda all_lines: F.aggregate(facts_of(all_lines), start, read))
    return let(
        folded,
        lambda s: s["person"].withField("name", F.coalesce(blank_to_null(s["person"]["name"]), s["first_free"])),
    )


def complete_text(value: Column) -> Column:
    """Trimmed of blanks and edge marks, NULL when nothing is left."""
    return blank_to_null(F.btrim(normalize_space(value), F.lit(K.CONTACT_EDGE_CHARS)))


def complete_contact_person(person: Column) -> Column:
    filled = F.coalesce(*[blank_to_null(person[name]) for name in K.PERSON_FIELDS]).isNotNull()
    return F.when(filled, F.struct(*[complete_text(person[name]).alias(name) for name in K.PERSON_FIELDS]))


def complete_contact(contact: Column, person: Column) -> Column:
    """All contact fields, tidied, plus the person."""
    fields = [complete_text(contact[name]).alias(name) for name in K.CONTACT_FIELDS]
    return F.struct(*fields, complete_contact_person(person).alias("contact_person"))


def has_contact_data(contact: Column) -> Column:
    """Some way to reach the contact is filled; a person counts when the struct has one."""
    return F.coalesce(*[blank_to_null(contact[name]) for name in K.CONTACT_DATA_FIELDS]).isNotNull()
