from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from gleaner.llm.queries import QUERIES
from gleaner.llm.repeats import find_repeats
from gleaner.llm.wordhash import Words, text_runs, windows


def brute(rows, length):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + length]) for _, w in words for k in range(len(w) - length + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def agree(docs, length):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = [(r.doc_id, r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans), r.kept_text) for r in find_repeats(docs, length).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, brute(rows, length)))


def test_query_against_all_windows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = QUERIES["op7_substring_dedup"](spark, "/root/testdata/sf0.001").collect()
    wanted = [(i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in brute([(r.doc_id, r.text) for r in docs.collect()], 35)]
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_odd_rows(odd_docs, no_docs):
    agree(odd_docs, 35)
    agree(odd_docs, 14)
    assert find_repeats(no_docs).count() == 0


def test_passages_at_every_shift(spark):
    draw = random.Random(2)
    word = lambda: f"w{draw.randrange(10**6)}"
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 90)]
    texts = []
    for k in range(120):
        body = [word() for _ in range(draw.randrange(40))]
        for _ in range(draw.randrange(3)):
            body += draw.choice(passages) + [word() for _ in range(draw.randrange(15))]
        texts.append((k, draw.choice([" ", "\n", "  "]).join(body)))
    texts += [(500, "a b " * 40), (501, " ".join(passages[0]))]
    agree(spark.createDataFrame(texts, "doc_id long, text string"), 35)


def test_word_numbers_do_not_depend_on_place():
    texts = [b"alpha beta  gamma", b"", b" beta alpha ", b"gamma\tdelta alpha", "größe alpha".encode(), b"x" * 3_000_000 + b" alpha"]
    seen: dict[bytes, set[int]] = {}
    for limit in (1, 40, 1 << 20):
        for low, high, data, offsets in text_runs(pa.array(texts, pa.binary()), limit):
            words = Words(data, offsets)
            numbers = words.numbers()
            for k in range(low, high):
                own = texts[k].split()
                a, b = words.first[k - low], words.first[k - low + 1]
                assert [data[s:e].tobytes() for s, e in zip(words.start[a:b], words.end[a:b])] == own
                for w, n in zip(own, numbers[a:b]):
                    seen.setdefault(w, set()).add(int(n))
    assert all(len(s) == 1 for s in seen.values())
    assert len(set.union(*seen.values())) == len(seen)


def test_windows_stay_inside_texts():
    at, value = windows(np.array([1, 2, 3, 1, 2, 3, 9], np.uint64), np.array([0, 3, 3, 7]), 3)
    assert at.tolist() == [0, 3, 4]
    assert value[0] == value[1] != value[2]
