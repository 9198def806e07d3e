"""The queries of the operators over the given tables, with their SQL where SQL can say it in time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.decontaminate import find_leaks
from gleaner.llm.exact_dups import exact_duplicates
from gleaner.llm.filter_audit import audit_filters
from gleaner.llm.licenses import scan_licenses
from gleaner.llm.lm import score_documents
from gleaner.llm.main_text import extract_main_text
from gleaner.llm.near_dups import near_duplicates
from gleaner.llm.packing import pack_documents
from gleaner.llm.prefix_trie import conversation_trie
from gleaner.llm.quality import classify_quality
from gleaner.llm.repeats import find_repeats
from gleaner.llm.shards import shard_documents
from gleaner.llm.url_rules import judge_urls

Query = Callable[[SparkSession, str], DataFrame]
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
#: Small enough that the smallest table splits; real shards are a hundred times that.
SHARD_BYTES = 256 << 10
TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(_table(spark, folder, "documents"))


def op2_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    values = ", ".join(str(rule) for rule in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    return judge_urls(_table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(_table(spark, folder, "documents"), TOKENIZER)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return classify_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"), shingle=3, percent=85)


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = find_repeats(_table(spark, folder, "documents"), 35)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(_table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"), "base_labels", "labels", "score",
    )


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(_table(spark, folder, "documents"))


def op10_extendible_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(_table(spark, folder, "documents"), SHARD_BYTES)


def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(_table(spark, folder, "pages"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_filters(_table(spark, folder, "documents"), _table(spark, folder, "labels"), part_col="source")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(_table(spark, folder, "conversations"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_lm_scoring, op2_url_rules, op3_decontamination, op4_best_fit_packing, op5_quality, op6_near_dedup, op7_substring_dedup,
        op8_license_scan, op9_exact_dedup, op10_extendible_shards, op11_html_extraction, op12_filter_audit,
        op13_prefix_trie,
    )
}

_RULES_SQL = "(VALUES " + ", ".join(str(rule) for rule in URL_RULES) + ") AS r(rule_host, rule_path, rule_verdict)"
ORACLES = {
    "op2_url_rules": f"""
        WITH cut AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, rest, regexp_extract(rest, '^[^/]*') AS raw FROM cut
        ), urls AS (
            SELECT row_number() OVER () AS row_no, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   substr(rest, length(raw) + 1) AS path FROM parts
        ), fit AS (
            SELECT u.row_no, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
            FROM urls u JOIN {_RULES_SQL} ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY u.row_no
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fit USING (row_no)""",
    "op6_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS shingle FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) t(i) WHERE len(ws) > 0
        ), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.size + y.size - shared)),
        either AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN either e ON e.a = r.b)
        SELECT d.doc_id, coalesce(size, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id""",
    "op7_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS words FROM w, unnest(range(1, len(ws) - 33)) t(i)),
        twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY words) > 1),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM twice, unnest(range(0, 35)) t(k)),
        kept AS (
            SELECT doc_id, string_agg(ws[i], ' ' ORDER BY i) AS text, count(*) AS n FROM (SELECT doc_id, ws, i FROM w, unnest(range(1, len(ws) + 1)) t(i)) x
            ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op10_extendible_shards": f"""
        WITH sized AS (
            SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS bits FROM documents
        ), level AS (
            SELECT doc_id, d AS depth, bits >> (60 - d) AS shard, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_rows
            FROM sized, range(0, 61) t(d) WINDOW w AS (PARTITION BY d, bits >> (60 - d))
        ), leaf AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM level WHERE shard_bytes <= {SHARD_BYTES} OR depth = 60)
        SELECT doc_id, n_bytes, 0 AS directory, depth::INT AS depth, shard, 0::BIGINT AS part, shard_bytes::BIGINT AS shard_bytes, shard_rows, shard_bytes > {SHARD_BYTES} AS oversized
        FROM leaf JOIN sized USING (doc_id) WHERE k = 1""",
    # The given pages name their article, hold no furniture inside it and few kinds of character references.
    "op11_html_extraction": r"""
        WITH inner_html AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages),
        plain AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS raw FROM inner_html),
        decoded AS (
            SELECT page_id, url, regexp_replace(replace(replace(replace(raw, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS words FROM plain
        ), tidy AS (SELECT page_id, url, trim(regexp_replace(words, '\s+', ' ', 'g')) AS text FROM decoded)
        SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM tidy""",
    "op12_filter_audit": r"""
        WITH RECURSIVE letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
        grown AS (SELECT '' AS o UNION ALL SELECT o || letter FROM grown JOIN letters ON NOT contains(o, letter)),
        steps AS (SELECT o AS filter_order, i::INT AS step, substr(o, 1, i - 1) AS before, substr(o, i, 1) AS own FROM grown, range(1, 6) t(i) WHERE length(o) = 5),
        docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        counted AS (
            SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) < doc_id AS copied,
                   length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals FROM docs
        ), failing AS (
            SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
                || CASE WHEN 100 * capitals > 2 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN copied THEN 'E' ELSE '' END AS fails FROM counted
        ), judged AS (
            SELECT part, fails, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM failing
        ), sets AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM judged GROUP BY ALL
        ), seen AS (
            SELECT part, filter_order, step, own, n, n_good, n_toxic, fails, contains(fails, own) AS hit,
                   length(before) = length(translate(before, fails, '')) AS here FROM sets, steps
        ), counts AS (
            SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (here AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND hit), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (NOT here AND hit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
                   coalesce(sum(n_good) FILTER (here AND hit), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (here AND hit), 0)::BIGINT AS toxic_lost
            FROM seen GROUP BY ALL
        )
        SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counts""",
    "op13_prefix_trie": r"""
        WITH RECURSIVE own AS (
            SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), crc AS (
            SELECT conv_id, conv_id::VARCHAR AS digits, 0 AS bit, 4294967295::BIGINT AS c FROM own
            UNION ALL
            SELECT conv_id, digits, bit + 1, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END FROM (
                SELECT *, CASE WHEN bit % 8 = 0 THEN xor(c, ascii(substr(digits, bit // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM crc WHERE bit < 8 * length(digits)
            ) step
        ), heads AS (SELECT conv_id, (xor(c, 4294967295::BIGINT) % 4)::INT AS h FROM crc WHERE bit = 8 * length(digits)),
        built AS (
            SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:h], o.turns[h + 1:]) AS turns
            FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
        ), paths AS (SELECT conv_id, len(turns) = d AS is_end, turns[1:d] AS path, d FROM built, unnest(range(0, len(turns) + 1)) t(d)),
        nodes AS (
            SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256,
                   CASE WHEN d > 0 THEN len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM paths GROUP BY path, d
        ), children AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
        sized AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
        below AS (
            SELECT path[1:up] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
            FROM sized, unnest(range(0, d + 1)) t(up) GROUP BY ALL
        )
        SELECT s.conv_id, s.d::BIGINT AS depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens, s.ends_sha256
        FROM sized s JOIN below USING (path) LEFT JOIN nodes p ON p.path = s.path[1:s.d - 1] AND s.d > 0""",
}
