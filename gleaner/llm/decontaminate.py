"""Benchmark decontamination: exact hits of an item's pieces, verified by Myers' bit-parallel edit distance."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import part_of, prepare, row_key, texts, without_rows

BLOCK_CHARS = 8 << 20
# ASCII letters lower-cased, digits and bytes beyond ASCII as they are, all else a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Scripts without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, Tai, Balinese, Javanese; kana, Bopomofo and Han. A character of them is a word.
_DENSE = (
    "[\u0e00-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u1b00-\u1b7f\ua980-\ua9ff\uaa60-\uaadf"
    "\u3005-\u3007\u3041-\u30fa\u30fc-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]"
)
_CHARACTER = re.compile(_DENSE)
#: Ideographic and full-width marks break words anywhere, general punctuation beside such a character.
_MARKS = re.compile(
    "[\u3000-\u3004\u3008-\u3020\u3030\u303d-\u303f\u30fb\ufe10-\ufe1f\ufe30-\ufe6f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]"
    f"|[\u2010-\u205e]+(?={_DENSE})|(?<={_DENSE})[\u2010-\u205e]+"
)
# First bytes of their UTF-8 forms, and of some other characters'.
_WIDE = re.compile(rb"[\xe0\xe1\xe3-\xf4]")
_SEARCHERS: dict[str, Searcher] = {}


def fold(text: bytes) -> list[bytes]:
    line = text.translate(_FOLD)
    if _WIDE.search(line):
        line = _CHARACTER.sub(r" \g<0> ", _MARKS.sub(" ", line.decode("utf-8", "surrogateescape"))).encode("utf-8", "surrogateescape")
    return line.split()


def closest(pattern: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """The smallest edit distance of the pattern to any run of the text, and where that run ends (exclusive; the first such).

    Myers' algorithm over words: column differences of the distance table are bits of two integers, and a text word is a few operations.
    """
    n = len(pattern)
    mask, high = (1 << n) - 1, 1 << (n - 1)
    equal: dict[bytes, int] = defaultdict(int)
    for k, word in enumerate(pattern):
        equal[word] |= 1 << k
    plus, minus, score = mask, 0, n
    best, end = n, 0
    for at, word in enumerate(text):
        same = equal.get(word, 0)
        down = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        more = minus | (~(across | plus) & mask)
        less = plus & across
        score += bool(more & high) - bool(less & high)
        more, less = (more << 1) & mask, (less << 1) & mask
        plus, minus = less | (~(down | more) & mask), more & down
        if score < best:
            best, end = score, at + 1
    return best, end


class Searcher:
    """Pieces of many items in one automaton; with an error budget of ``e`` an item has ``e + 1`` pieces, so one of them is unharmed.
    Items under ``min_words`` words have no budget."""

    def __init__(self, items: list[tuple[int, list[bytes]]], errors: float, min_words: int):
        import ahocorasick

        self.items, self.budget = items, [math.floor(len(words) * errors) if len(words) >= min_words else 0 for _, words in items]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list] = defaultdict(list)
        for k, (_, words) in enumerate(items):
            cuts = [len(words) * j // (self.budget[k] + 1) for j in range(self.budget[k] + 2)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                places[(b" " + b" ".join(words[low:high]) + b" ").decode("utf-8", "replace")].append((k, high))
        for piece, value in places.items():
            self.automaton.add_word(piece, value)
        if places:
            self.automaton.make_automaton()

    def search(self, text: bytes) -> list[tuple[int, ...]]:
        """For each item that the text holds within its budget: item id, distance, first and last word of the closest place, number of places,
        words of the text and of the item."""
        if not len(self.automaton):
            return []
        words = fold(text)
        line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
        spots: dict[int, set[int]] = defaultdict(set)
        spaces = None
        for end, value in self.automaton.iter(line):
            if spaces is None:
                spaces = np.flatnonzero(np.array([c == " " for c in line]))
            done = int(np.searchsorted(spaces, end))
            for k, high in value:
                spots[k].add(done - high)
        found = []
        for k, starts in spots.items():
            item, pattern = self.items[k]
            budget, n, reached, wanted = self.budget[k], len(pattern), -1, None
            best, count = None, 0
            for start in sorted(starts):
                low, high = max(0, start - budget), min(len(words), start + n + budget)
                if high <= reached:
                    continue
                window = words[low:high]
                wanted = wanted or set(pattern)
                if len(wanted.intersection(window)) < len(wanted) - budget:
                    continue
                distance, end = closest(pattern, window)
                if distance <= budget:
                    _, back = closest(pattern[::-1], window[:end][::-1])
                    first = low + end - back
                    count, reached = count + 1, low + end
                    if best is None or distance < best[0]:
                        best = (distance, first, low + end - 1)
            if best:
                found.append((item, *best, count, len(words), n))
        return sorted(found)


def find_leaks(
    docs: DataFrame, items: DataFrame, errors: float = 0.2, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", n_words: bool = False,
) -> DataFrame:
    """Documents that hold a benchmark item: ``doc_id, item_id, distance, first_word, last_word, places``, one row per document and item.

    With ``n_words``, also the numbers of words of the document and the item, ``n_words`` and ``item_words``.

    Words are ASCII-lowered runs of digits, letters and anything beyond ASCII; in scripts without spaces (Chinese, Japanese, Thai and others) each
    character is a word, and their marks and full-width ones break words like ASCII marks. An item of ``n`` words has a budget of ``errors * n`` (rounded
    down) inserted, dropped or replaced words. It is cut into one more piece than that: where the document holds it within the budget, one
    piece at least stands there word for word. The pieces of all items are one automaton; each hit is verified on the words around it
    by Myers' bit-parallel edit distance over words. ``distance``, ``first_word`` and ``last_word`` are those of the closest place (the first
    of equals), ``places`` counts places that do not overlap.

    The items are the query set. They go to the tasks in blocks of about 8 million characters, each one pass over the documents; documents
    are never shuffled or copied, and texts are searched whole. Items under ``min_words`` words have no error budget: only where
    they stand word for word, they are found. Null and empty texts and items, and items of marks alone, match nothing; a null id stays null; repeated rows of documents are rows of the
    result each, items that repeat in id and text count once. Empty tables give no rows. Extra columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    queries = texts(items, item_id_col, item_text_col).distinct().withColumnRenamed("doc_id", "item_id")
    size = queries.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_CHARS))
    rows = texts(docs, id_col, text_col).select("doc_id", F.encode("text", "utf-8").alias("text"))
    kinds = {"doc_id": "long", "item_id": "long", "distance": "int", "first_word": "long", "last_word": "long", "places": "long"}
    kinds |= {"n_words": "long", "item_words": "long"} if n_words else {}
    names, schema = list(kinds), ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    out = None
    for block in range(blocks):
        chosen = queries.where(part_of("item_id", "text", parts=blocks) == block).orderBy("item_id", "text").collect()
        query_set = [(row["item_id"], words) for row in chosen if (words := fold(row["text"].encode()))]
        shared = spark.sparkContext.broadcast((query_set, f"{spark.sparkContext.applicationId}-{id(query_set)}-{block}"))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_set, name = shared.value
            if name not in _SEARCHERS:
                _SEARCHERS.clear()
                _SEARCHERS[name] = Searcher(query_set, errors, min_words)
            searcher = _SEARCHERS[name]
            for batch in batches:
                found = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    found += [(doc, *row)[: len(names)] for row in searcher.search(text.as_buffer().to_pybytes())]
                columns = zip(*found) if found else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "distance" else pa.int64()) for c, n in zip(columns, names)], names)

        part = rows.mapInArrow(work, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(
    docs: DataFrame, items: DataFrame, min_share: float = 0.5, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", errors: float = 0.2,
) -> DataFrame:
    """The input rows whose text holds no item, with all their columns.

    Rows are judged by id and text, so a clean text stays where its id repeats with a leaking one, and rows with a null id are judged like
    others. An item under ``min_words`` words stands in many texts by chance, a single word in most: such a hit makes a row go only
    where the item's words are at least ``min_share`` of the text's.
    """
    marked = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    leaks = find_leaks(marked, items, errors, min_words, "row", "text", item_id_col, item_text_col, n_words=True)
    long = F.col("last_word") - F.col("first_word") + 1
    telling = leaks.where((F.col("item_words") >= min_words) | (long >= min_share * F.col("n_words")))
    return without_rows(docs, telling.select("doc_id"), id_col, text_col)
