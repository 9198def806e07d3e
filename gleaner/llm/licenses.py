"""License scan by a positional index of rare words. DataFrame operations only."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.staging import settled
from gleaner.llm.common import settle, texts
from gleaner.llm.url_rules import ASCII_LOWER, ASCII_UPPER

# Everything that ends a word: ASCII other than digits and letters.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, a sentence of the licence or of its usual notices, and its mandatory key phrases, which must stand at their places in it.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free", "charge")),
    ("mit", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("merge publish distribute sublicense",)),
    ("mit", "this permission notice shall be included in all copies or substantial portions of the software", ("permission notice shall", "substantial portions")),
    ("apache", "licensed under the apache license version 2 0", ("apache license version",)),
    ("apache", "you may not use this file except in compliance with the license", ("file except", "compliance", "license")),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "under the terms of the gnu lesser general public license version 3", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license version 3", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source", "binary forms")),
    ("bsd", "redistribution and use in source and in binary forms with or without modification are permitted", ("in binary forms",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("must retain", "above copyright notice")),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", ("must reproduce", "above copyright notice")),
    ("mpl", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license version",)),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("without fee", "hereby granted")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released", "public domain")),
    *((f"cc-by{'-' * bool(kind)}{kind}", f"licensed under cc by {kind} {version}".replace("  ", " "), (f"cc by {kind} {version}".replace("  ", " "),)) for kind in ("", "nc", "sa", "nd") for version in ("3 0", "4 0")),
    *(("cc-by", f"licensed under a creative commons attribution {version} international license", (f"creative commons attribution {version}",)) for version in ("3 0", "4 0")),
)
#: A template is matched where its key phrases stand in place and its words in place have this share of the IDF of all its words.
MIN_SHARE = 0.2
#: Words of a template that a text looks up: the highest in IDF of those that it has.
LOOKED_UP = 3
INDEXED_LENGTH = 5


def _words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def _indexed(templates: tuple, phrases: dict[str, str]) -> list[str]:
    """Words with postings: those of key phrases, and the templates' longer words."""
    found = {w for phrase in phrases for w in _words(phrase)}
    for _, notice, keys in templates:
        found |= {*_words(" ".join(keys)), *(w for w in _words(notice) if len(w) >= INDEXED_LENGTH)}
    return sorted(found)


def license_index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``doc_id, n_words, postings``: how many words each text has, and where those of the vocabulary stand (``pos``, ``word``)."""
    pieces = texts(docs).select("doc_id", F.split("text", BREAKS).alias("w"))
    blank = lambda i: (F.element_at("w", i) == "").cast("int")
    lead = blank(1)
    size = F.size("w")
    low = [F.lit(w) for w in sorted({v.lower() for v in vocabulary})]
    at = F.transform("w", lambda w, i: F.struct((i - lead).alias("pos"), w.alias("word")))
    likely = F.filter(at, lambda x: F.lower(x["word"]).isin(*low))
    ascii_low = F.transform(likely, lambda x: F.struct(x["pos"].alias("pos"), F.translate(x["word"], ASCII_UPPER, ASCII_LOWER).alias("word")))
    return pieces.select(
        "doc_id",
        (size - lead - F.when(size > 1, blank(-1)).otherwise(0)).cast("long").alias("n_words"),
        F.filter(ascii_low, lambda x: x["word"].isin(*vocabulary)).alias("postings"),
    )


def _positions(word: str) -> Column:
    return F.transform(F.filter("postings", lambda x: x["word"] == word), lambda x: x["pos"].cast("long"))


def _shifted(positions: Column, offset: int) -> Column:
    return F.transform(positions, lambda p: p - offset)


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(label).alias("label")))


def _starts(places: dict[str, str], word: str, offset: int) -> Column:
    """Where a text with ``word`` at ``offset`` would start, for each place of the word."""
    return _shifted(F.col(places[word]), offset)


def _phrase(places: dict[str, str], words: list[str]) -> Column:
    """Starts of the places where these words stand one after another."""
    return reduce(F.array_intersect, [F.array_distinct(_starts(places, w, k)) for k, w in enumerate(words)])


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] | None = None, templates: tuple = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, places, base_labels, labels, score``.

    Words are ASCII-lowered runs of digits, ASCII letters and anything beyond ASCII. ``places`` has the starts (words from 0) of all places
    where a base phrase stands, with its label. The index keeps, for each text, the positions of the licence words: those of key phrases
    and the templates' words of five letters and more. Document frequencies of these words over all texts give their IDF.

    A text looks up, for each template, the template's words with the highest IDF among those it has, and the rarest word of the key
    phrases, without which nothing can match. Each place of such a word, less the word's offset in the template, is a candidate start. The key
    phrases are verified there: every word of theirs must stand in place. Then all index words of the template that stand in place vote for
    the start with their IDF, and the template is matched where they have at least ``min_share`` of the template's IDF. Words elsewhere
    neither help nor hinder. ``labels`` are the labels of matched templates and base phrases, both sorted and comma-joined; ``score`` is the
    largest IDF share of a matched template, 0 without one.

    Everything about one text is in one row, so no group can be hot; the only shuffle counts, map-side first, as many
    words as the templates have. Position lists are intersected by hashing and votes are sorted, so a text of nothing but licence words is
    no quadratic work. Null
    and empty texts have no words, no place, empty labels, score 0. Repeated rows and null ids are rows like others. An empty table gives no
    rows. Extra columns are not read.
    """
    phrases = BASE_PHRASES if phrases is None else phrases
    vocabulary = _indexed(templates, phrases)
    index = settle(license_index(texts(docs, id_col, text_col), vocabulary))
    seen = index.select(F.explode(F.array_distinct("postings.word")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # At most one row for each word of the templates.
    frequency = {row["word"]: row["n"] for row in seen.collect()}
    total = index.count()
    idf = {w: math.log((total + 1) / (frequency.get(w, 0) + 1)) + 0.01 for w in vocabulary}

    places = {w: f"_at{k}" for k, w in enumerate(vocabulary)}
    at = {name: _positions(w) for w, name in places.items()}
    held = settled(index.where(F.size("postings") > 0), at).drop("postings")

    steps = {
        f"_base{k}": _labelled(_phrase(places, _words(p)), label)
        for k, (p, label) in enumerate(phrases.items())
    }
    weights = []
    for k, (_, notice, keys) in enumerate(templates):
        words = _words(notice)
        indexed = sorted({w for w in words if w in places}, key=lambda w: (-idf[w], w))
        mandatory = key_places(words, keys)
        rarest = max(mandatory, key=lambda m: (idf[m[1]], m[1]))
        looked_up = F.slice(F.filter(F.array(*[_all_starts(places, words, w) for w in indexed]), lambda starts: F.size(starts) > 0), 1, LOOKED_UP)
        candidates = F.array_distinct(F.concat(F.flatten(looked_up), _starts(places, rarest[1], rarest[0])))
        steps[f"_start{k}"] = reduce(F.array_intersect, [_starts(places, w, i) for i, w in sorted(mandatory, key=lambda m: -idf[m[1]])], candidates)
        weight = sum(idf[w] for w in indexed)
        weights.append([(w, idf[w] / weight) for w in indexed])
    votes = {
        f"_share{k}": F.when(
            F.size(f"_start{k}") > 0,
            _most(F.concat(*[_votes(F.array_intersect(_all_starts(places, _words(notice), w), F.col(f"_start{k}")), share) for w, share in weights[k]])),
        ).otherwise(0.0)
        for k, (_, notice, _) in enumerate(templates)
    }
    matched = lambda k: F.col(f"_share{k}") >= min_share
    names = [F.when(matched(k), F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for k, (label, *_) in enumerate(templates)]
    shares = [F.when(matched(k), F.col(f"_share{k}")).otherwise(0.0) for k in range(len(templates))]
    base = F.concat(*[F.col(f"_base{k}") for k in range(len(phrases))])
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    found = settled(settled(settled(held, steps), {"places": base}), votes).select(
        "doc_id", "n_words", "places", join(F.col("places.label")).alias("base_labels"),
        join(F.concat(F.col("places.label"), *names)).alias("labels"), F.least(F.lit(1.0), F.greatest(*shares)).alias("score"),
    )
    none = index.where(F.size("postings") == 0).select(
        "doc_id", "n_words", F.array().cast("array<struct<start: long, label: string>>").alias("places"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score")
    )
    return found.unionByName(none)


def key_places(words: list[str], keys: tuple[str, ...]) -> list[tuple[int, str]]:
    """Offset and word of all words of the key phrases, each phrase at its first place behind the one before."""
    found, at = [], 0
    for phrase in map(_words, keys):
        at = next(i for i in range(at, len(words)) if words[i : i + len(phrase)] == phrase)
        found += [(at + i, w) for i, w in enumerate(phrase)]
        at += len(phrase)
    return found


def _all_starts(places: dict[str, str], words: list[str], word: str) -> Column:
    """Possible starts of a template by one of its words, which may stand at several offsets."""
    offsets = [i for i, w in enumerate(words) if w == word]
    return F.array_distinct(F.concat(*[_starts(places, word, i) for i in offsets]))


def _votes(starts: Column, share: float) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(share).alias("share")))


def _most(votes: Column) -> Column:
    """The largest sum of shares that one start has."""
    zero = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("most"))

    def add(held: Column, vote: Column) -> Column:
        own = vote["share"] + F.when(held["start"].eqNullSafe(vote["start"]), held["sum"]).otherwise(0.0)
        return F.struct(vote["start"].alias("start"), own.alias("sum"), F.greatest(held["most"], own).alias("most"))

    return F.aggregate(F.array_sort(votes), zero, add, lambda held: held["most"])
