from __future__ import annotations

import math
import random
import re

from gleaner.llm.licenses import BASE_PHRASES, MIN_SHARE, TEMPLATES, _indexed, key_places, scan_licenses
from gleaner.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(k, label) for phrase, label in BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def agree(docs, found):
    wanted = [(r.doc_id, *base(r.text)) for r in docs.collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def test_base_columns_of_the_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = QUERIES["op8_license_scan"](spark, "/root/testdata/sf0.01").collect()
    agree(docs, [tuple(r)[:6] for r in rows])
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in rows)
    assert all(0 <= r.score <= 1 and (r.score > 0) >= bool(r.base_labels) for r in rows)


def test_notices(spark):
    texts = {
        1: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        2: "x Licensed under the Apache License, Version 2.0. MIT\tLICENSE",
        3: "This work is licensed under the GNU General Public License, version 3.",
        4: "GNU LESSER General Public License, version 3",
        5: "Redistribution and use in source and binary forms, with or without modification, are permitted",
        6: "Licensed under CC BY-NC 4.0.",
        7: "mit the license; an apache has a license; public general license by cc",
        8: "", 9: None, 10: "mit license " * 3000, 11: "emit license mıt license KMIT LICENSE", 12: "MIT", 13: ", MIT License.", 14: "granted hereby free",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert {k: r.labels for k, r in rows.items() if r.labels} == {
        1: "mit", 2: "apache,mit", 3: "gpl", 4: "gpl,lgpl", 5: "bsd", 6: "cc-by-nc", 10: "mit", 13: "mit",
    }
    agree(docs, [(k, r.n_words, len(r.places), min((p.start for p in r.places), default=None), max((p.start for p in r.places), default=None), r.base_labels) for k, r in rows.items()])
    assert rows[1].score > 0.9 and rows[7].score == 0


def test_phrases_that_are_no_notices(spark):
    texts = ["Plant spores take binary forms in winter.", "the request hereby granted free of doubt", "See cc by nc for the train timetable", "we do not use the Mozilla Public License here"]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.labels, r.score) for r in rows] == [("", 0.0)] * 4


def aligned(texts):
    """Labels and score by laying every template over every place of every text."""
    vocabulary = set(_indexed(TEMPLATES, BASE_PHRASES))
    split = [WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) for text in texts]
    idf = {w: math.log((len(texts) + 1) / (sum(w in words for words in split) + 1)) + 0.01 for w in vocabulary}
    out = []
    for words in split:
        labels = {label for phrase, label in BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()}
        best = 0.0
        for label, notice, keys in TEMPLATES:
            notice = notice.split()
            weight = sum(idf[w] for w in {*notice} & vocabulary)
            for start in range(-len(notice), len(words)):
                here = [i for i in range(len(notice)) if 0 <= start + i < len(words) and words[start + i] == notice[i]]
                if all(i in here for i, _ in key_places(notice, keys)):
                    share = sum(idf[w] for w in {notice[i] for i in here} & vocabulary) / weight
                    if share >= MIN_SHARE:
                        labels.add(label)
                        best = max(best, share)
        out.append((",".join(sorted(labels)), round(min(best, 1.0), 9)))
    return out


def test_labels_and_scores_equal_a_plain_alignment(spark):
    rng = random.Random(4)
    words = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()} | {"spore", "winter", "é"})
    texts = ["", None, "mit license " * 40]
    for _ in range(250):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            notice = rng.choice(TEMPLATES)[1].split()
            low = rng.randrange(len(notice))
            part = notice[low : low + rng.randrange(1, 20)] if rng.random() < 0.5 else notice
            # Some words change, go or come.
            parts += [w if rng.random() < 0.93 else rng.choice(words) for w in part if rng.random() < 0.97] + rng.choices(words, k=rng.randrange(4))
        texts.append(rng.choice([" ", ", "]).join(parts))
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r.doc_id: (r.labels, round(r.score, 9)) for r in rows}
    assert found == dict(enumerate(aligned(texts)))
    assert len({label for labels, _ in found.values() for label in labels.split(",")}) > 10


def test_words_elsewhere_do_not_veto(spark):
    """A notice keeps its label where its other words stand in the prose around it, out of place; words count for one start only."""
    prose = "Under these terms the version at hand is subject to change, with software and permission under its own version. " * 20
    notices = {
        "mit": "MIT License", "mpl": "Mozilla Public License, v. 2.0", "lgpl": "GNU Lesser General Public License v3", "bsd": "in binary forms, changed or not",
        "cc-by": "Creative Commons Attribution 4.0", "cc-by-nc": "CC BY-NC 4.0", "apache": "Apache License, Version 2.0",
    }
    docs = [(k, f"{prose}{notice}. {prose}") for k, notice in enumerate(notices.values())] + [(50, "MIT License under"), (51, prose), (52, "released under the x license; mit license"), (53, "mit license")]
    rows = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, label in enumerate(notices):
        assert label in rows[k].labels.split(",") and 0 < rows[k].score < 1, label
    assert rows[50].labels == "mit" and rows[50].score > 0 and rows[51].labels == "" and rows[51].score == 0
    assert rows[52].labels == "mit" and rows[52].score == rows[53].score


def test_odd_rows(odd_docs, no_docs):
    found = scan_licenses(odd_docs).collect()
    agree(odd_docs, [(r.doc_id, r.n_words, 0, None, None, "") for r in found])
    assert scan_licenses(no_docs).count() == 0


def test_native(spark):
    plan = QUERIES["op8_license_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
