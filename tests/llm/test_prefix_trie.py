from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.llm.prefix_trie import conversation_trie
from gleaner.operators.running import running_before

SCHEMA = "conv_id long, turn long, role string, text string, place long, block string, words long"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _key(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", _key(role or "", text or ""), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = (*own.get(int(c / 20) * 20, [])[:h], *turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = set()
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if built[c] == node)))
        out.add((
            min(held), len(node), min(members[node[:-1]]) if node else None, len(held), children[node], sum(not children[u] for u in below[node]),
            sum((len(members[u]) - 1) * words(u) for u in below[node]), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "clash", 9) for r in rows], SCHEMA)


def check(spark, rows, block):
    found = [tuple(r[n] for n in NAMES) for r in conversation_trie(table(spark, rows), block).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows)


@pytest.mark.parametrize("block", [1, 3, 4])
def test_random_conversations(spark, block):
    rng = random.Random(block)
    rows = [
        (c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, " c\td  e "]))
        for c in rng.sample(range(0, 200), 90) for t in range(rng.randrange(1, 11))
    ]
    check(spark, rows, block)


def test_odd_rows(spark):
    long = "wörd " * 50_000
    rows = [
        (1, None, "user", "x y"), (1, None, "user", "x y"), (1, 0, None, None), (None, 0, "user", "no conversation"), (2, 5, "user", "x y"), (2, 5, "assistant", "x y"),
        (2, 5, "user", "a"), (45, 0, "user", long), (45, 1, "user", long), (47, 0, "user", "alone"), (60, 0, "us", "er"), (61, 0, "use", "r"), (60, 1, "user", ""),
        (-5, 0, "user", "negative"), (-5, 1, "user", "negative"), (-20, 0, "user", "x"),
    ]
    check(spark, rows, 4)
    assert conversation_trie(table(spark, [])).count() == 0


def test_one_conversation_holds_most_rows(spark):
    rows = [(20, t, "user", f"turn {t % 7}") for t in range(900)] + [(c, t, "user", f"turn {t}") for c in range(21, 60) for t in range(6)]
    rows += [(c, t, "user", f"turn {t % 7}") for c in (400, 401, 402) for t in range(30)]
    check(spark, rows, 4)


def test_running_totals_cross_partitions(spark):
    rows = spark.range(0, 4000, 1, 9).selectExpr("if(id % 3 = 0, 7L, id % 50) AS key", "id AS at", "id * 31 % 101 AS value")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = running_before(rows, "key", [F.col("at")], {"n": ("count", "value", 0), "total": ("sum", "value", 0), "mixed": ("bit_xor", "value", 0)}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen = defaultdict(lambda: [0, 0, 0])
    assert len(found) == 4000
    for r in sorted(found, key=lambda r: r["at"]):
        state = seen[r.key]
        assert [r.n, r.total, r.mixed] == state
        seen[r.key] = [state[0] + 1, state[1] + r.value, state[2] ^ r.value]
