from __future__ import annotations

import random

from gleaner.llm.decontaminate import closest, drop_leaks, find_leaks, fold


def table(pattern, text):
    """Distance of the pattern to its closest run of the text, and that run's end, by dynamic programming."""
    row = list(range(len(pattern) + 1))
    best, end = len(pattern), 0
    for j, word in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != word), row[i] + 1, new[i - 1] + 1))
        row = new
        if row[-1] < best:
            best, end = row[-1], j
    return best, end


def test_bit_parallel_distance():
    draw = random.Random(1)
    for _ in range(400):
        pattern = [b"%d" % draw.randrange(4) for _ in range(draw.randint(1, 90))]
        text = [b"%d" % draw.randrange(4) for _ in range(draw.randint(0, 60))]
        assert closest(pattern, text) == table(pattern, text)


def harm(words, errors, draw):
    out = list(words)
    for _ in range(errors):
        k = draw.randrange(len(out))
        kind = draw.randrange(3)
        if kind == 0:
            out[k] = f"zz{draw.randrange(999)}"
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, f"qq{draw.randrange(999)}")
    return out


def test_planted_items_against_whole_search(spark):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(5, 60)))) for k in range(12)] + [(50, "too short"), (51, None), (52, "")]
    docs = []
    for k in range(80):
        body = [draw.choice(words) for _ in range(draw.randrange(60))]
        if k % 2:
            own = items[draw.randrange(12)][1].split()
            body += harm(own, draw.randrange(len(own) // 3 + 1), draw)
        docs.append((k, ", ".join(body + [draw.choice(words) for _ in range(10)]).title()))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in find_leaks(*frames).collect()}
    wanted = {}
    for d, text in docs:
        for i, item in items[:12]:
            distance, _ = table(fold(item.encode()), fold(text.encode()))
            if distance <= len(item.split()) // 5:
                wanted[(d, i)] = distance
    assert found == wanted and len(wanted) > 10
    left = {r.doc_id for r in drop_leaks(*frames).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in wanted}


def test_spans_and_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "brown fox jumps over the lazy cat"), (1, "brown fox jumps over the lazy cat"), (2, "nothing of the kind stands here")], "item_id long, text string")
    found = find_leaks(odd_docs, items).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.distance, r.first_word, r.places) for r in found) == [(0, 1, 1, 2, 8), (1, 1, 1, 2, 8), (2, 1, 1, 2, 8), (2, 1, 1, 2, 8)]
    assert find_leaks(no_docs, items).count() == 0 and find_leaks(odd_docs, items.limit(0)).count() == 0


def test_whole_items_in_documents(spark):
    """Every benchmark item that a document holds word for word is found, and nothing else is near."""
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    lines = {r.doc_id: b" " + b" ".join(fold(r.text.encode())) + b" " for r in docs.collect()}
    wanted = {(d, r.item_id) for r in items.collect() for d, line in lines.items() if b" " + b" ".join(fold(r.text.encode())) + b" " in line}
    found = {(r.doc_id, r.item_id): r.distance for r in find_leaks(docs, items).collect()}
    assert wanted and wanted == {k for k, d in found.items() if d == 0}


def test_scripts_without_spaces_and_short_items(spark):
    """Characters are the words of such scripts, with an error budget like others; short items are found word for word only."""
    items = spark.createDataFrame(
        [(1, "水の都の古い橋を渡る人々は夜明けに歌う"), (2, "北京的秋天是一年中最美的季节"), (3, "แมวดำนั่งอยู่บนหลังคา"), (4, "Alpha Beta"), (5, "水"), (6, "。、！")], "item_id long, text string"
    )
    docs = [
        (1, "昨日、水の都の古い橋を渡る人々は夜明けに歌う。と書いた"), (2, "x水の都の青い橋を渡る人々は、夜に歌う！"), (3, "他说：“北京的秋天，是一年中最美的季节。”"), (4, "เมื่อวานแมวดำนั่งอยู่บนหลังคาบ้าน"),
        (5, "see alpha, BETA there"), (6, "alpha then beta"), (7, "北京"), (8, "雨。、！"),
    ]
    found = {(r.doc_id, r.item_id): (r.distance, r.first_word) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert found == {(1, 1): (0, 2), (2, 1): (3, 1), (1, 5): (0, 2), (2, 5): (0, 1), (3, 2): (0, 2), (4, 3): (0, 8), (5, 4): (0, 1)}
    assert fold("Grüße “an” alle — 1,5 한국어".encode()) == "Grüße “an” alle — 1 5 한국어".replace("G", "g").encode().split()
