from __future__ import annotations

import random

import pytest

from gleaner.llm import near_dups
from gleaner.llm.components import connected_components
from gleaner.llm.near_dups import keep_one_of_each, near_duplicates


def brute(rows, size, percent):
    sets = []
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets.append((i, {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where: dict = {}
    for k, (_, s) in enumerate(sets):
        for shingle in s:
            where.setdefault(shingle, []).append(k)
    for k, (i, s) in enumerate(sets):
        if i is None:
            continue
        for j in {j for shingle in s for j in where[shingle] if j < k and sets[j][0] is not None}:
            common = len(s & sets[j][1])
            if 100 * common >= percent * (len(s) + len(sets[j][1]) - common):
                root[find(k)] = find(j)
    low: dict = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return [(i, len(s), low.get(find(k)) if i is not None else None, i is not None and low[find(k)] == i) for k, (i, s) in enumerate(sets)]


def agree(docs, size, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = [tuple(r) for r in near_duplicates(docs, size, percent).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, brute(rows, size, percent)))


def family(seed, n, words, changes):
    """Copies of one text, each with up to ``changes`` words changed."""
    draw = random.Random(seed)
    base = [f"w{seed}x{k}" for k in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(draw.randint(0, changes)):
            own[draw.randrange(words)] = f"y{draw.randrange(10**9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(spark, size, percent):
    agree(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), size, percent)


def test_odd_rows(odd_docs, no_docs):
    agree(odd_docs, 3, 85)
    assert near_duplicates(no_docs).count() == 0
    assert keep_one_of_each(odd_docs, 3, 85).columns == odd_docs.columns


def test_dense_family(spark):
    texts = family(1, 400, 120, 12) + family(2, 40, 60, 3) + family(3, 5, 200, 5)
    random.Random(9).shuffle(texts)
    agree(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"), 3, 85)


def test_large_regions_are_cut_and_whole(spark, monkeypatch):
    """Regions over the limit go deeper and, at the last level, are compared part by part."""
    monkeypatch.setattr(near_dups, "REGION_ROWS", 24)
    texts = family(1, 150, 120, 4)
    agree(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85)


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    low = {n: n for edge in links for n in edge}
    for _ in range(400):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: c for n, c in low.items() if n != c}
