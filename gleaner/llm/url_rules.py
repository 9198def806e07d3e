"""URL rules as intervals of reversed hosts, found by a sorted sweep with a stack of nested rules. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import part_of, width

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` and ``path`` of the URL; both empty where it is null or has no ``://``."""
    after = F.expr("substr(_url, instr(_url, '://') + 3)")
    rest = F.when(F.instr("_url", "://") > 0, F.substring_index(F.substring_index(after, "#", 1), "?", 1)).otherwise("")
    host = F.substring_index("_rest", "/", 1)
    return (
        df.withColumn("_url", F.coalesce(F.col(url_col).cast("string"), F.lit("")))
        .withColumn("_rest", rest)
        .withColumn("host", F.translate(host, ASCII_UPPER, ASCII_LOWER))
        .withColumn("path", F.expr("substr(_rest, length(host) + 1)"))
        .drop("_url", "_rest")
    )


def host_key(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``: a domain's key is a prefix of the keys of all its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def nested_prefixes(prefixes: DataFrame) -> DataFrame:
    """For each row (``head``, ``prefix``): ``stack``, all prefixes of its head that enclose it, shortest first, itself last.

    Each prefix is cut to all its own beginnings, which meet the prefixes by equality; the work is the length of the rules.
    """
    known = prefixes.select("head", "prefix").distinct()
    cuts = known.withColumn("cut", F.explode(F.expr("transform(sequence(1, length(prefix)), n -> substr(prefix, 1, n))")))
    return (
        cuts.join(known.select("head", F.col("prefix").alias("cut")), ["head", "cut"])
        .groupBy("head", "prefix")
        .agg(F.sort_array(F.collect_set("cut")).alias("stack"))
    )


def enclosing(keys: DataFrame, prefixes: DataFrame, salts: int) -> DataFrame:
    """For each distinct row (``head``, ``key``) the prefixes of its head whose interval [prefix, prefix + any) holds the key.

    Sort-merge range join: starts of intervals and keys are sorted together and swept once. The last start before a key brings the
    stack of rules that were open there; intervals of prefixes are nested, so those that have ended are the ones that are no
    beginning of the key, and popping them leaves exactly the open rules. Keys of one head are split in ``salts`` sweeps by their
    hash, and the few starts stand in each of them, so a head that holds a third of all keys is many tasks. Only keys inside an
    interval come back: ``head, key, stack``.
    """
    number = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    starts = nested_prefixes(prefixes).select("head", number.alias("salt"), F.col("prefix").alias("key"), F.lit(0).alias("is_key"), "stack")
    swept = keys.select("head", part_of("key", parts=salts).alias("salt"), "key", F.lit(1).alias("is_key"), F.lit(None).cast("array<string>").alias("stack"))
    sweep = Window.partitionBy("head", "salt").orderBy("key", "is_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        starts.unionByName(swept)
        .withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
        .where("is_key = 1 and stack is not null")
        .select("head", "key", F.expr("filter(stack, p -> startswith(key, p))").alias("stack"))
        .where(F.size("stack") > 0)
    )


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """The rows with ``host, path, rule, verdict``. ``rules``: ``host, path, verdict``, as a table of any size.

    A rule fits its host and all subdomains where the URL's path starts with the rule's path; of the rules that fit, the longest
    (host and path together, then the longer host) decides. Where none fits, ``rule`` is null and the verdict is ``default``.

    Two sweeps: over reversed hosts, for the open host rules of each distinct host, then over the paths of URLs on such hosts. Both run on
    distinct values, so a host or URL that is a third of all rows is swept once; the verdicts join back by URL, a plain shuffle join that
    Spark splits where a URL is hot. Null URLs and URLs without ``://`` have empty host and path and no rule. Rows are kept one
    by one, repeated ones too. An empty table, or no rules, gives no rows or no rule. Input columns named like a result give
    way to it; other columns stay.
    """
    salts = width(urls.sparkSession)
    results = ["host", "path", "rule", "verdict"]
    rows = with_parts(urls.drop(*(set(results) - {url_col})), url_col)
    rule_rows = rules.select(F.translate("host", ASCII_UPPER, ASCII_LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    rule_rows = rule_rows.where("rule_host <> ''").withColumn("rule_key", host_key(F.col("rule_host")))
    top = lambda key: F.substring_index(key, ".", 1)
    distinct = rows.where("host <> ''").select("host", "path").distinct()

    hosts = distinct.select(host_key(F.col("host")).alias("key")).distinct().withColumn("head", top(F.col("key")))
    open_hosts = enclosing(hosts, rule_rows.select(top(F.col("rule_key")).alias("head"), F.col("rule_key").alias("prefix")), salts)
    on_rules = open_hosts.select(F.col("key").alias("host_key"), F.explode("stack").alias("head"))

    # An empty path is the beginning of every path; the mark before it keeps such rules inside a sweep.
    paths = distinct.withColumn("host_key", host_key(F.col("host"))).join(on_rules, "host_key").withColumn("key", F.concat(F.lit("|"), F.col("path")))
    starts = rule_rows.select(F.col("rule_key").alias("head"), F.concat(F.lit("|"), F.col("rule_path")).alias("prefix"))
    open_paths = enclosing(paths.select("head", "key").distinct(), starts, salts).select("head", "key", F.element_at("stack", -1).alias("prefix"))
    by_start = rule_rows.groupBy(F.col("rule_key").alias("head"), F.concat(F.lit("|"), F.col("rule_path")).alias("prefix")).agg(
        F.min(F.struct("rule_verdict", "rule_host", "rule_path")).alias("r")
    )
    fitting = paths.join(open_paths, ["head", "key"]).join(by_start, ["head", "prefix"])
    length = F.length("r.rule_host") + F.length("r.rule_path")
    best = fitting.groupBy("host", "path").agg(F.max(F.struct(length.alias("n"), F.length("r.rule_host").alias("h"), "r")).alias("best"))
    best = best.select("host", "path", F.concat("best.r.rule_host", "best.r.rule_path").alias("rule"), F.col("best.r.rule_verdict").alias("verdict"))
    judged = rows.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return judged.select(*[c for c in urls.columns if c not in set(results) or c == url_col], *[c for c in results if c != url_col])
