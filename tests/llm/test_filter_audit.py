from __future__ import annotations

import re
from itertools import permutations

import pytest

from gleaner.llm.filter_audit import audit_filters

LABELS = "doc_id long, quality int, toxic int, source string"


def brute(docs, labels):
    """All orders by applying the filters to the rows, one after the other."""
    rows = [(r.doc_id, r.text or "", r.source or "") for r in docs.collect()]
    good = {r.doc_id for r in labels.collect() if r.quality == 1} - {None}
    toxic = {r.doc_id for r in labels.collect() if r.toxic == 1} - {None}
    low: dict = {}
    for i, text, _ in rows:
        if i is not None:
            low[text] = min(low.get(text, i), i)
    fails = []
    for i, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails.append({
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and low[text] < i,
        })
    out, shapley = {}, {}
    for part in {p for *_, p in rows}:
        here = [k for k, r in enumerate(rows) if r[2] == part]
        for order in permutations("ABCDE"):
            left = set(here)
            for step, letter in enumerate(order):
                hit = {k for k in left if fails[k][letter]}
                failing = {k for k in here if fails[k][letter]}
                left -= hit
                alone = sum(sum(fails[k].values()) == 1 for k in failing)
                out[part, "".join(order), step + 1] = (
                    len(left), len(hit), len(failing - hit - left), alone, sum(rows[k][0] in good for k in hit), sum(rows[k][0] in toxic for k in hit),
                )
                shapley[part, letter] = shapley.get((part, letter), 0) + len(hit)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (2, 1, 1, "x"), (2, 0, None, "x"), (6, None, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x")], LABELS)


def test_odd_rows(odd_docs, labels):
    assert found(audit_filters(odd_docs, labels)) == brute(odd_docs, labels)


def test_copies_in_any_part(spark, labels):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(i, (long, "SHOUT $5", "a b c", long + " #")[i % 4], f"s{i % 3}") for i in range(60)] + [(3, "a b c", "s0"), (None, long, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert found(audit_filters(docs, labels)) == brute(docs, labels)


def test_empty_tables(no_docs, odd_docs, labels):
    assert audit_filters(no_docs, labels).count() == 0
    bare = audit_filters(odd_docs, labels.limit(0))
    assert bare.where("good_lost + toxic_lost > 0").count() == 0
    assert bare.count() == 600 * odd_docs.selectExpr("coalesce(source, '')").distinct().count()


def test_semi_join_on_hash_text_and_smaller_id(odd_docs, labels):
    plan = audit_filters(odd_docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftSemi, .*hash128.*text.*low.*< doc_id", plan)
