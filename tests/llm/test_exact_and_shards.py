from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from gleaner.llm.exact_dups import exact_duplicates, keep_first
from gleaner.llm.shards import shard_documents


def test_exact_on_odd_rows(odd_docs, no_docs):
    found = exact_duplicates(odd_docs).collect()
    rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "")) for r in odd_docs.collect()]
    sizes = Counter(t for _, t in rows)
    low = defaultdict(lambda: None)
    for i, t in rows:
        if i is not None and (low[t] is None or i < low[t]):
            low[t] = i
    wanted = [(i, low[t], sizes[t], i == low[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    assert exact_duplicates(no_docs).count() == 0


def test_keep_first_keeps_rows(odd_docs):
    kept = keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3, 5, 6, 7, 8, 9, 10, 12]


def _splits(rows, limit):
    """Extendible hashing by hand: (id, bytes) to depth and prefix."""
    bits = [(int(hashlib.md5(str(i if i is not None else "null").encode()).hexdigest()[:15], 16), i, n) for i, n in rows]
    out, open_ = {}, [(0, 0, bits)]
    while open_:
        depth, prefix, held = open_.pop()
        if sum(n for *_, n in held) <= limit or depth == 60:
            out |= {i: (depth, prefix, sum(n for *_, n in held)) for _, i, _ in held}
            continue
        for bit in (0, 1):
            part = [x for x in held if (x[0] >> (59 - depth)) & 1 == bit]
            if part:
                open_.append((depth + 1, prefix * 2 + bit, part))
    return out


def test_shards_split_bit_by_bit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    limit = 20_000
    found = shard_documents(docs, limit).collect()
    wanted = _splits([(r.doc_id, len((r.text or "").encode())) for r in docs.collect()], limit)
    assert len(found) == 1000
    for r in found:
        if r.directory == 0:
            assert (r.depth, r.shard, r.shard_bytes) == wanted[r.doc_id]
        else:
            assert wanted[r.doc_id][2] > limit
    sums = Counter()
    for r in found:
        sums[(r.directory, r.depth, r.shard, r.part)] += r.n_bytes
    for r in found:
        assert sums[(r.directory, r.depth, r.shard, r.part)] == r.shard_bytes
        assert r.shard_bytes <= limit or (r.oversized and r.shard_rows == 1)


def test_shards_of_one_repeated_row(spark, odd_docs, no_docs):
    same = spark.range(0, 1000, 1, 7).selectExpr("5L AS doc_id", "repeat('x', 10) AS text").unionByName(spark.range(3).selectExpr("5L AS doc_id", "repeat('y', 40 + int(id)) AS text"))
    found = shard_documents(same, 95).collect()
    groups = defaultdict(list)
    for r in found:
        groups[(r.directory, r.depth, r.shard, r.part)].append(r)
    assert len(found) == 1003
    assert all(sum(r.n_bytes for r in g) == g[0].shard_bytes <= 95 and len(g) == g[0].shard_rows for g in groups.values())
    odd = shard_documents(odd_docs, 1000)
    assert odd.count() == odd_docs.count() and odd.where("oversized and shard_rows > 1").count() == 0
    assert shard_documents(no_docs, 100).count() == 0
