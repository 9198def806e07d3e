"""Contact queries over the lines of whole documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import pick, pick_sql, quote, sql_list
from gleaner import constants as K
from gleaner.functions import contacts as C
from gleaner.functions.text import split_lines
from gleaner.operators.contacts import read_contacts
from gleaner.functions.staging import settled
from gleaner.sources.tables import read_table

LABELS = ["Phone:", "Fax:", "x", "Email", "mobile 5", "Tel", "y", ":mail:", "Telephone", "z", "w"]
PREFIXES = [
    "Phone: ", "Television ", "E-mail- ", "", "Address: ", "Fax ", "Postal Code ", "Province ", "Country:", "cell", "", "Regional ",
    "ZIP code: ", "name:", "City ", "Mailing ", "",
]


def _text_lines(spark, d):
    """Non-empty lines of each document, as an array."""
    docs = read_table(spark, d, "documents", spread=True).select("doc_id", "text")
    return settled(docs, {"lines": split_lines(F.col("text"))}).drop("text").filter(F.size("lines") > 0)


_LINES_SQL = r"""
  select doc_id, i - 1 as pos, ls[i] as line from (
    select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))), lambda x: x <> '') as ls
    from documents) s, unnest(range(1, len(ls) + 1)) as t(i)"""


def _labels_between(spark, d):
    """Every line is followed by a label or filler, so labels meet lines and each other."""
    docs = _text_lines(spark, d)
    spread = F.flatten(
        F.transform("lines", lambda line, i: F.array(line, pick(LABELS, F.col("doc_id") + i), pick(LABELS, F.col("doc_id") * 3 + i)))
    )
    return docs.select("doc_id", spread.alias("lines"))


_LABELS_SQL = f"""
  select doc_id, pos * 3 + k as pos, case k when 0 then line when 1 then {pick_sql(LABELS, 'doc_id + pos')} else {pick_sql(LABELS, 'doc_id * 3 + pos')} end as line
  from ({_LINES_SQL}) l, unnest([0, 1, 2]) as u(k)"""


def q_pair_labels(spark, d):
    paired = _labels_between(spark, d).select("doc_id", F.posexplode(C.pair_label_lines(F.col("lines"))).alias("pos", "line"))
    return paired.withColumn("pos", F.col("pos").cast("bigint"))


# The check numbers the labels of every run of label lines: even ones take the next line, odd ones are taken.
def _pair_sql(lines: str) -> str:
    return f"""
with l as ({lines}),
m as (select *, list_contains({sql_list(K.PAIRED_LABELS)}, trim(lower(line), ':')) as lab from l),
g as (select *, sum(case when lab then 0 else 1 end) over (partition by doc_id order by pos) as grp from m),
n as (select *, case when lab then row_number() over (partition by doc_id, grp, lab order by pos) - 1 end as nr from g),
w as (select *, lag(nr) over (partition by doc_id order by pos) as before, lead(line) over (partition by doc_id order by pos) as following from n),
k as (select doc_id, pos, case when nr % 2 = 0 and following is not null then line || ' ' || following else line end as line
  from w where before is null or before % 2 = 1)
select doc_id, row_number() over (partition by doc_id order by pos) - 1 as pos, line from k"""


SQL_PAIR_LABELS = _pair_sql(_LABELS_SQL)


def _prefixed(spark, d):
    docs = _text_lines(spark, d)
    return docs.select("doc_id", F.transform("lines", lambda line, i: F.concat(pick(PREFIXES, F.col("doc_id") + i), line)).alias("lines"))


_PREFIXED_SQL = f"select doc_id, pos, {pick_sql(PREFIXES, 'doc_id + pos')} || line as line from ({_LINES_SQL}) l"
_WSQ = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _labeled_sql(part: str) -> str:
    cases = []
    for key, names in K.LABEL_PATTERNS:
        pattern = "'(?i)^(?:" + names.replace(r"\s", _WSQ) + ")" + _WSQ + "*[:\\-]?" + _WSQ + "*(.+)$'"
        result = quote(key) if part == "key" else f"trim(regexp_extract(line, {pattern}, 1))"
        cases.append(f"when regexp_matches(line, {pattern}) then {result}")
    return "case " + " ".join(cases) + " end"


def q_labeled_value(spark, d):
    rows = _prefixed(spark, d).select("doc_id", F.posexplode("lines").alias("pos", "line"))
    found = C.labeled_value(F.col("line"))
    return rows.withColumn("found", found).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "found.key", "found.value")


SQL_LABELED_VALUE = f"select doc_id, pos, {_labeled_sql('key')} as key, {_labeled_sql('value')} as value from ({_PREFIXED_SQL}) p"


def q_pivot_first(spark, d):
    facts = C.line_facts(F.col("lines"))
    held = _prefixed(spark, d).withColumn("facts", facts)
    keys = [key for key, _ in K.LABEL_PATTERNS]
    return held.select("doc_id", *[C.first_labeled(F.col("facts"), key)["value"].alias(key) for key in keys])


SQL_PIVOT_FIRST = f"""
with p as (select doc_id, pos, {_labeled_sql('key')} as key, {_labeled_sql('value')} as value from ({_PREFIXED_SQL}) p
  where not list_contains({sql_list(K.SKIPPED_LABELS)}, trim(lower(line), ':')))
select d.doc_id, {", ".join(f"arg_min(value, pos) filter (key = '{key}' and value <> '') as {key}" for key, _ in K.LABEL_PATTERNS)}
from (select distinct doc_id from ({_LINES_SQL}) l) d left join p on d.doc_id = p.doc_id group by d.doc_id"""

HEADINGS = ["Postal-Code", "E-Mail", "TEL", " Mobile ", "Fax", "Province", "Name", "Opening hours", "Contact Person", "city"]


def q_contact_label(spark, d):
    rows = _text_lines(spark, d).select("doc_id", F.posexplode("lines").alias("pos", "line"))
    heading = F.when(F.col("pos") % 3 == 2, F.split_part("line", F.lit(" "), F.lit(1))).otherwise(pick(HEADINGS, F.col("doc_id") + F.col("pos")))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), C.contact_label(heading).alias("field"))


def _label_sql(heading: str) -> str:
    snake = f"trim(regexp_replace(lower({heading}), '[^a-z0-9]+', '_', 'g'), '_')"
    table = "map {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in K.CONTACT_LABEL_ALIASES.items()) + "}"
    return f"coalesce({table}[{snake}], case when list_contains({sql_list([*K.CONTACT_FIELDS, 'contact_person'])}, {snake}) then {snake} end)"


_HEADING_SQL = f"case when pos % 3 = 2 then split_part(line, ' ', 1) else {pick_sql(HEADINGS, 'doc_id + pos')} end"
SQL_CONTACT_LABEL = f"select doc_id, pos, {_label_sql(_HEADING_SQL)} as field from ({_LINES_SQL}) l"


def q_pivot_last(spark, d):
    docs = _text_lines(spark, d).select(
        "doc_id", "lines", F.transform("lines", lambda _, i: C.contact_label(pick(HEADINGS, F.col("doc_id") + i))).alias("labels")
    )
    return docs.select("doc_id", *[C.last_per_label(F.col("labels"), F.col("lines"), key).alias(key) for key in K.CONTACT_FIELDS])


SQL_PIVOT_LAST = f"""
with p as (select doc_id, pos, line, {_label_sql(pick_sql(HEADINGS, 'doc_id + pos'))} as key from ({_LINES_SQL}) l)
select doc_id, {", ".join(f"arg_max(line, pos) filter (key = '{key}') as {key}" for key in K.CONTACT_FIELDS)} from p group by doc_id"""

# --- places and addresses -----------------------------------------------------------------------

PLACE_TAILS = [" ON L4K 1A1", ", NV 89501", ", ON, M5V 2T6", "", ", Peru, ", " qc h2x-1y4", ", tx 78701-1234", " Main Road 12"]
PLACE_LINES = ["Canada", "m5v 2t6", "Suite 12", "a@b.co", "USA", "Vaughan ON L4K 1A1", "x", "Lima, Lima, Peru"]


def _place_lines(spark, d):
    docs = _text_lines(spark, d)
    spread = F.flatten(
        F.transform(
            "lines",
            lambda line, i: F.array(
                pick(PLACE_LINES, F.col("doc_id") + i * 3),
                F.concat(F.replace(line, F.lit(","), F.lit(" ")), pick(PLACE_TAILS, F.col("doc_id") + i)),
            ),
        )
    )
    # Lines of a text are tidy, so put-together ones are tidied again.
    tidy = F.filter(F.transform(spread, lambda line: F.trim(line)), lambda line: line != "")
    return docs.select("doc_id", tidy.alias("lines"))


_PLACES_SQL = f"""
  select doc_id, row_number() over (partition by doc_id order by pos, k) - 1 as pos, line from (
    select doc_id, pos, k, trim(case k when 0 then {pick_sql(PLACE_LINES, 'doc_id + pos * 3')} else replace(line, ',', ' ') || {pick_sql(PLACE_TAILS, 'doc_id + pos')} end) as line
    from ({_LINES_SQL}) l, unnest([0, 1]) as u(k)) s where line <> ''"""
_CA = r"'(?i)^(.+?)\s+([A-Z]{2})\s+([A-Z][0-9][A-Z][ -]?[0-9][A-Z][0-9])$'"
_US = r"'(?i)^(.+?),\s*([A-Z]{2})\s+([0-9]{5}(?:-[0-9]{4})?)$'"


def _place_facts_sql(lines: str) -> str:
    return f"""
  select doc_id, pos, line,
    case when regexp_matches(line, {_CA}) then trim(regexp_extract(line, {_CA}, 1), ', ') when regexp_matches(line, {_US}) then trim(regexp_extract(line, {_US}, 1)) end as city,
    case when regexp_matches(line, {_CA}) then upper(regexp_extract(line, {_CA}, 2)) when regexp_matches(line, {_US}) then upper(regexp_extract(line, {_US}, 2)) end as state,
    case when regexp_matches(line, {_CA}) then upper(regexp_extract(line, {_CA}, 3)) when regexp_matches(line, {_US}) then regexp_extract(line, {_US}, 3) end as post_code,
    list_filter(list_transform(string_split(line, ','), lambda x: trim(x)), lambda x: x <> '') as parts from ({lines}) p"""


_PLACE_SQL = _place_facts_sql(_PLACES_SQL)


def q_city_line(spark, d):
    rows = _place_lines(spark, d).select("doc_id", F.posexplode("lines").alias("pos", "line"))
    rows = rows.withColumns({"p": C.parse_city_state_post(F.col("line")), "t": C.parse_city_state_country(F.col("line"))})
    return rows.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "line", "p.city", "p.state", "p.post_code",
        F.col("t.city").alias("three_city"), F.col("t.state").alias("three_state"), F.col("t.country").alias("three_country"),
        C.is_canadian_post_code(F.col("line")).alias("is_post_code"),
    )


SQL_CITY_LINE = f"""
select doc_id, pos, line, city, state, post_code, case when len(parts) = 3 then parts[1] end as three_city,
  case when len(parts) = 3 then parts[2] end as three_state, case when len(parts) = 3 then parts[3] end as three_country,
  regexp_matches(line, '(?i)^[A-Z][0-9][A-Z][ -]?[0-9][A-Z][0-9]$') as is_post_code from ({_PLACE_SQL}) q"""


def q_heading_line(spark, d):
    return _place_lines(spark, d).select("doc_id", C.heading_line(F.col("lines")).alias("heading"))


# Word edges are spelled out, since RE2 knows only ASCII letters as word characters.
_EDGE = r"[^\p{L}\p{M}\p{N}_]"
_HEADING_OK = (
    rf"not (regexp_matches(line, '[\p{{L}}\p{{M}}\p{{N}}_.+-]+@[\p{{L}}\p{{M}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}') or city is not null or list_contains({sql_list(K.COUNTRY_LINES)}, lower(line)) "
    rf"or (regexp_matches(line, '[0-9]') and regexp_matches(line, '(?i)(?:^|{_EDGE})(?:st|street|road|rd|drive|dr|ave|avenue|blvd|suite)(?:$|{_EDGE})')))"
)
SQL_HEADING_LINE = f"select doc_id, arg_min(line, pos) filter ({_HEADING_OK}) as heading from ({_PLACE_SQL}) q group by doc_id"


def q_address_fields(spark, d):
    held = _place_lines(spark, d).withColumn("a", C.address_fields(F.col("lines")))
    return held.select("doc_id", "a.city", "a.state", "a.post_code", "a.country", F.array_join("a.address_lines", ", ").alias("address"))


# The check walks the lines with a recursive query.
SQL_ADDRESS_FIELDS = f"""
with recursive q as ({_PLACE_SQL}),
f as (select *, list_contains({sql_list(K.COUNTRY_LINES)}, lower(line)) as is_country,
  regexp_matches(line, '(?i)^[A-Z][0-9][A-Z][ -]?[0-9][A-Z][0-9]$') as is_post from q),
n as (select doc_id, max(pos) as last_pos from f group by doc_id),
w(doc_id, pos, c_city, c_state, c_post, c_country, rest) as (
  select distinct doc_id, cast(-1 as bigint), cast(null as varchar), cast(null as varchar), cast(null as varchar), cast(null as varchar), cast([] as varchar[]) from f
  union all
  select w.doc_id, f.pos,
    case when (is_country and c_country is null) or (is_post and c_post is null) then c_city when len(parts) = 3 then coalesce(c_city, parts[1]) else coalesce(c_city, city) end,
    case when (is_country and c_country is null) or (is_post and c_post is null) then c_state when len(parts) = 3 then coalesce(c_state, parts[2]) else coalesce(c_state, state) end,
    case when is_country and c_country is null then c_post when is_post and c_post is null then upper(line) when len(parts) = 3 then c_post else coalesce(c_post, post_code) end,
    case when is_country and c_country is null then line when is_post and c_post is null then c_country when len(parts) = 3 then coalesce(c_country, parts[3]) else c_country end,
    case when (is_country and c_country is null) or (is_post and c_post is null) or len(parts) = 3 or city is not null then rest else list_append(rest, line) end
  from w join f on f.doc_id = w.doc_id and f.pos = w.pos + 1)
select w.doc_id, c_city as city, c_state as state, c_post as post_code, c_country as country, array_to_string(rest, ', ') as address
from w join n on n.doc_id = w.doc_id and n.last_pos = w.pos"""


def q_contact_lines(spark, d):
    """All contact fields of every document, read from its labelled and unlabelled lines."""
    held = read_contacts(_prefixed(spark, d))
    return held.select("doc_id", *[F.col(f"contact.{name}").alias(name) for name in K.CONTACT_FIELDS])


_EMAIL_SQL = r"nullif(regexp_extract(line, '[\p{L}\p{M}\p{N}_.+-]+@[\p{L}\p{M}\p{N}_.-]+\.[A-Za-z]{2,}'), '')"
_KEYS = [key for key, _ in K.LABEL_PATTERNS]
# The check finds mail, name and leftover lines by groups, then walks the leftover lines.
SQL_CONTACT_LINES = f"""
with recursive a as materialized (select *, list_contains({sql_list(K.SKIPPED_LABELS)}, trim(lower(line), ':')) as skipped,
  {_labeled_sql('key')} as key, {_labeled_sql('value')} as value, {_EMAIL_SQL} as email from ({_PREFIXED_SQL}) p),
lab as (select doc_id, {", ".join(f"arg_min(value, pos) filter (key = '{k}' and value <> '' and not skipped) as l_{k}" for k in _KEYS)},
  min(pos) filter (key = 'mail' and value <> '' and not skipped) as mail_pos,
  min(pos) filter (key is null and not skipped and not ends_with(line, ':') and email is not null) as email_pos,
  arg_min(email, pos) filter (key is null and not skipped and not ends_with(line, ':') and email is not null) as first_email from a group by doc_id),
m as (select *, coalesce(email_pos < mail_pos, email_pos is not null) as email_wins from lab),
r as (select * from (select a.doc_id, pos, case when email_wins and pos = email_pos then trim(replace(line, email, ''), ' :-') else line end as line
  from a join m on m.doc_id = a.doc_id where key is null and not skipped and not ends_with(line, ':')) t where line <> ''),
rf as materialized ({_place_facts_sql('select * from r')}),
h as (select doc_id, arg_min(line, pos) filter ({_HEADING_OK}) as heading from rf group by doc_id),
n as (select m.*, coalesce(l_name, heading) as name, case when l_name is null then heading end as used from m left join h on h.doc_id = m.doc_id),
f as materialized (select rf.*, row_number() over (partition by rf.doc_id order by pos) - 1 as k, list_contains({sql_list(K.COUNTRY_LINES)}, lower(line)) as is_country,
  regexp_matches(line, '(?i)^[A-Z][0-9][A-Z][ -]?[0-9][A-Z][0-9]$') as is_post, line is distinct from name as other
  from rf join n on n.doc_id = rf.doc_id where used is null or line <> used),
w(doc_id, k, c_city, c_state, c_post, c_country, rest) as (
  select doc_id, cast(-1 as bigint), l_city, l_state, l_post_code, l_country, cast([] as varchar[]) from n
  union all
  select w.doc_id, f.k,
    case when (is_country and c_country is null) or (is_post and c_post is null) then c_city when len(parts) = 3 then coalesce(c_city, parts[1]) else coalesce(c_city, city) end,
    case when (is_country and c_country is null) or (is_post and c_post is null) then c_state when len(parts) = 3 then coalesce(c_state, parts[2]) else coalesce(c_state, state) end,
    case when is_country and c_country is null then c_post when is_post and c_post is null then upper(line) when len(parts) = 3 then c_post else coalesce(c_post, post_code) end,
    case when is_country and c_country is null then line when is_post and c_post is null then c_country when len(parts) = 3 then coalesce(c_country, parts[3]) else c_country end,
    case when (is_country and c_country is null) or (is_post and c_post is null) or len(parts) = 3 or city is not null or not other then rest else list_append(rest, line) end
  from w join f on f.doc_id = w.doc_id and f.k = w.k + 1),
e as (select * from w qualify row_number() over (partition by doc_id order by k desc) = 1)
select n.doc_id, name, coalesce(l_address, nullif(array_to_string(rest, ', '), '')) as address, c_city as city, c_post as post_code, c_state as state,
  c_country as country, l_telephone as telephone, l_phone as phone, l_fax as fax, case when email_wins then first_email else l_mail end as mail
from n join e on e.doc_id = n.doc_id"""


def q_person_lines(spark, d):
    held = _labels_between(spark, d).withColumn("p", C.person_fields(F.col("lines")))
    return held.select("doc_id", "p.*")


_NAMED = r"'(?i)^(.+?)\s+(phone|telephone|tel|fax)\s*:\s*(.*)$'"
SQL_PERSON_LINES = f"""
with recursive l as ({_pair_sql(f'select doc_id, pos, trim(line) as line from ({_LABELS_SQL}) t')}),
a as (select *, lead(line) over (partition by doc_id order by pos) as following, regexp_matches(line, {_NAMED}) as named,
  trim(regexp_extract(line, {_NAMED}, 1)) as n_name, lower(regexp_extract(line, {_NAMED}, 2)) as n_label, trim(regexp_extract(line, {_NAMED}, 3)) as n_value,
  case when trim(lower(line), ':') in ('phone', 'mobile', 'cell') then 'phone' when trim(lower(line), ':') in ('telephone', 'tel') then 'telephone'
    when trim(lower(line), ':') = 'fax' then 'fax' end as lone_key, {_labeled_sql('key')} as l_key, {_labeled_sql('value')} as l_value, {_EMAIL_SQL} as email from l),
b as (select *, not named and following is not null and lone_key is not null as lone from a),
f as materialized (select *, case when named then case n_label when 'fax' then 'fax' when 'phone' then 'phone' else 'telephone' end when lone then lone_key
    when l_key = 'mail' then 'email' else l_key end as key,
  case when named then coalesce(nullif(n_value, ''), following) when lone then following else l_value end as value,
  not named and not lone and l_key is null as free, lone or (named and n_value = '' and following is not null) as takes,
  case when email is not null then trim(replace(line, email, ''), ' :-') else line end as rest from b),
w(doc_id, pos, name, email, phone, telephone, fax, first_free, skip) as (
  select distinct doc_id, cast(-1 as bigint), cast(null as varchar), cast(null as varchar), cast(null as varchar), cast(null as varchar), cast(null as varchar), cast(null as varchar), false from f
  union all
  select w.doc_id, f.pos,
    case when skip then name when named then coalesce(nullif(name, ''), nullif(n_name, '')) when key = 'name' then coalesce(value, name) else name end,
    case when skip then w.email when free and f.email is not null then f.email when key = 'email' then coalesce(value, w.email) else w.email end,
    case when not skip and key = 'phone' then coalesce(value, phone) else phone end,
    case when not skip and key = 'telephone' then coalesce(value, telephone) else telephone end,
    case when not skip and key = 'fax' then coalesce(value, fax) else fax end,
    case when skip then first_free else coalesce(first_free, case when free and rest <> ''
      and not (regexp_matches(rest, '^[0-9\\s().+xXetET-]+$') and regexp_matches(rest, '[0-9]')) then rest end) end,
    case when skip then false else takes end
  from w join f on f.doc_id = w.doc_id and f.pos = w.pos + 1)
select doc_id, coalesce(nullif(name, ''), first_free) as name, email, phone, telephone, fax from w
qualify row_number() over (partition by doc_id order by pos desc) = 1"""

# --- single texts -------------------------------------------------------------------------------


def _texts(spark, d):
    docs = read_table(spark, d, "documents", spread=True).select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"), "text")
    talk = read_table(spark, d, "conversations", spread=True).select(F.lit("c").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    return docs.unionByName(talk)


_TEXTS_SQL = "select 'd' as kind, doc_id as id, 0 as turn, text from documents union all select 'c', conv_id, turn, text from conversations"


def q_email(spark, d):
    return _texts(spark, d).select("kind", "id", "turn", C.extract_email(F.col("text")).alias("email"))


SQL_EMAIL = rf"""
select kind, id, turn, nullif(regexp_extract(text, '[\p{{L}}\p{{M}}\p{{N}}_.+-]+@[\p{{L}}\p{{M}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}'), '') as email from ({_TEXTS_SQL}) t"""


def q_contact_signal(spark, d):
    return _texts(spark, d).select("kind", "id", "turn", C.has_contact_signal(F.col("text")).alias("signal"))


_WORD = r"[\p{L}\p{M}\p{N}_]"
SQL_CONTACT_SIGNAL = rf"""
select kind, id, turn, contains(text, '@') or contains(lower(text), 'mailto:')
  or regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(?:telephone|tel|phone|fax|email|address|postal|zip)(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])') as signal
from ({_TEXTS_SQL}) t"""

PHONES = ["555-1234", "(705) 692-3333 ext 4", "+46 8 12", "call 5", "", "x-", " 12 34 "]


def q_phone(spark, d):
    rows = _texts(spark, d).select("kind", "id", "turn", F.explode(F.array(F.col("text"), pick(PHONES, F.col("id") + F.col("turn")))).alias("text"))
    return rows.select("kind", "id", "turn", F.sha2("text", 256).alias("text"), C.looks_like_phone(F.col("text")).alias("is_phone"))


SQL_PHONE = rf"""
select kind, id, turn, sha256(text) as text, regexp_matches(trim(text), '^[0-9\s().+xXetET-]+$') and regexp_matches(text, '[0-9]') as is_phone
from (select kind, id, turn, unnest([text, {pick_sql(PHONES, 'id + turn')}]) as text from ({_TEXTS_SQL}) t) u"""

_NAMES = [
    "pair_labels", "labeled_value", "pivot_first", "contact_label", "pivot_last", "city_line", "heading_line",
    "address_fields", "contact_lines", "person_lines", "email", "contact_signal", "phone",
]
QUERIES = {f"q_{name}": globals()[f"q_{name}"] for name in _NAMES}
ORACLES = {f"q_{name}": globals()[f"SQL_{name.upper()}"] for name in _NAMES}
