"""Substring dedup: passages that repeat anywhere, found by anchors at the positions of a difference cover."""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import part_of, prepare, texts, width
from gleaner.llm.wordhash import Words, text_runs, windows

# A perfect difference cover: any difference modulo 13 is that of two of these four numbers.
PERIOD, COVER = 13, (0, 1, 3, 9)
BLOCK_BYTES, MOST_BLOCK_BYTES = 4 << 20, 64 << 20
_COVERED = np.isin(np.arange(PERIOD), COVER)


def _anchors(words: Words, numbers: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``length`` words that start at a cover position of their text."""
    at, value = windows(numbers, words.first, length)
    begin = np.repeat(words.first[:-1], np.diff(words.first))[at]
    hit = _COVERED[(at - begin) % PERIOD]
    return at[hit], value[hit]


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of a (n, lanes) array, and how often each stands there."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    ordered = values[np.lexsort(values.T[::-1])] if values.shape[1] > 1 else np.sort(values, axis=0)
    new = np.flatnonzero(np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)]))
    return ordered[new], np.diff(np.append(new, len(ordered)))


def _known(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which rows stand in the sorted table. Rows that agree in the first lane stand side by side there and are all looked at."""
    out = np.zeros(len(values), bool)
    if not len(table):
        return out
    spot = np.searchsorted(table[:, 0], values[:, 0])
    open_ = np.arange(len(values))
    while len(open_):
        open_ = open_[spot[open_] < len(table)]
        open_ = open_[table[spot[open_], 0] == values[open_, 0]]
        same = (table[spot[open_]] == values[open_]).all(axis=1)
        out[open_[same]] = True
        open_ = open_[~same]
        spot[open_] += 1
    return out


def _rows(blobs: pa.ChunkedArray, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), "<u8").reshape(-1, lanes)


def _split(values: np.ndarray, block: int, buckets: int) -> pa.Table:
    """Rows for the counting step: the block's distinct values by bucket, those met once apart from those met more often."""
    values, counts = _distinct(values)
    bucket = (values[:, 0] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows: list[list] = [[], [], [], []]
    for b in np.flatnonzero(np.diff(cuts)):
        part = order[cuts[b] : cuts[b + 1]]
        many = counts[part] > 1
        for column, value in zip(rows, (int(b), block, values[part[~many]].tobytes(), values[part[many]].tobytes())):
            column.append(value)
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(r, k) for r, k in zip(rows, kinds)], names=["bucket", "block", "once", "more"])


_PARTS = "bucket int, block int, once binary, more binary"


def _repeated(parts: DataFrame, lanes: int) -> DataFrame:
    """For each block, those of its values that stand at least twice in the corpus: ``block, found`` (several rows a block).

    A bucket holds each value once for each block that has it, so one that a third of all documents share costs a few bytes for each block.
    """

    def count(table: pa.Table) -> pa.Table:
        more = _rows(table.column("more"), lanes)
        once = _rows(table.column("once"), lanes)
        distinct, number = _distinct(once)
        twice = _distinct(np.concatenate([distinct[number > 1], more]))[0]
        hit = _known(twice, once)
        blocks, found, at = [], [], 0
        for block, own, sure in zip(table.column("block").to_pylist(), table.column("once").to_pylist(), table.column("more").to_pylist()):
            to = at + len(own) // (8 * lanes)
            blob = once[at:to][hit[at:to]].tobytes() + sure
            at = to
            if blob:
                blocks.append(block)
                found.append(blob)
        return pa.table({"block": pa.array(blocks, pa.int32()), "found": pa.array(found, pa.binary())})

    return parts.groupBy("bucket").applyInArrow(count, "block int, found binary")


def _candidates(words: Words, anchors: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``length`` words that hold a repeated anchor at one of their first ``PERIOD`` words: start and 128-bit number."""
    numbers = words.numbers(0)
    at, value = _anchors(words, numbers, length - PERIOD + 1)
    hits = at[_known(anchors, value[:, None])]
    if not len(hits):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    near = np.zeros(len(numbers) + 1, np.int32)
    np.add.at(near, np.maximum(hits - PERIOD + 1, 0), 1)
    np.add.at(near, hits + 1, -1)
    open_ = np.cumsum(near[:-1]) > 0
    start, first = windows(numbers, words.first, length)
    chosen = open_[start]
    second = windows(words.numbers(1), words.first, length)[1]
    return start[chosen], np.stack([first[chosen], second[chosen]], axis=1)


def find_repeats(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, spans, kept_text``.

    A window is ``length`` consecutive words of one text; it repeats if its words also start anywhere else, in the same text or
    another one. ``spans`` are the maximal runs of words (first, last, counted from 0) that repeating windows cover, ``kept_text``
    the other words, joined by one space. Windows are judged on the input; all copies of a passage go, the first one too.

    Anchors are windows of ``length - 12`` words, hashed only where a word's position modulo 13 is in the cover {0, 1, 3, 9}. For any two
    positions there is a shift below 13 that brings both onto the cover, so two equal windows of full length share an anchor at the same
    shift. Texts are dealt to blocks of 4 to 64 MB, once; all three readings use that one shuffle. Each block sends its distinct anchors,
    by hash bucket; a bucket answers with those that stand twice; blocks extend these to the full windows around them and send those
    as 128-bit numbers the same way; then each block marks what its repeating windows cover. What moves is a few packed
    numbers for each block, not for each occurrence, so a passage that most documents share is no hot group, and no pair is ever made.

    Null and empty texts have no words. Repeated rows count as different places, so their windows repeat. Null ids are kept.
    An empty table gives no rows. Extra columns are not read.
    """
    if length <= PERIOD:
        raise ValueError(f"length must be over {PERIOD}")
    spark = docs.sparkSession
    prepare(spark)
    rows = texts(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = width(spark)
    blocks = max(1, math.ceil(total / MOST_BLOCK_BYTES), min(math.ceil(total / BLOCK_BYTES), 16 * buckets))
    dealt = rows.select("doc_id", F.encode("text", "utf-8").alias("text"), part_of("doc_id", "text", parts=blocks).alias("block"))

    def send_anchors(table: pa.Table) -> pa.Table:
        found = []
        for _, _, data, offsets in text_runs(table.column("text")):
            words = Words(data, offsets)
            found.append(_anchors(words, words.numbers(0), length - PERIOD + 1)[1])
        return _split(np.concatenate(found)[:, None], table.column("block")[0].as_py(), buckets)

    def send_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        anchors = _distinct(_rows(answers.column("found"), 1))[0]
        found = [_candidates(Words(data, offsets), anchors, length)[1] for _, _, data, offsets in text_runs(table.column("text"))]
        return _split(np.concatenate(found), table.column("block")[0].as_py(), buckets)

    def mark(table: pa.Table, answers: pa.Table) -> pa.Table:
        lanes = answers.column("lanes").to_numpy()
        anchors = _distinct(_rows(answers.column("found").filter(pa.array(lanes == 1)), 1))[0]
        twice = _distinct(_rows(answers.column("found").filter(pa.array(lanes == 2)), 2))[0]
        n_words, spans, kept = [], [], []
        for low, high, data, offsets in text_runs(table.column("text")):
            words = Words(data, offsets)
            start, value = _candidates(words, anchors, length)
            step = np.zeros(len(words.start) + 1, np.int32)
            hits = start[_known(twice, value)]
            np.add.at(step, hits, 1)
            np.add.at(step, hits + length, -1)
            gone = np.cumsum(step[:-1]) > 0
            raw = data.tobytes()
            for k in range(high - low):
                a, b = words.first[k], words.first[k + 1]
                own, text = gone[a:b], raw[offsets[k] : offsets[k + 1]].split()
                n_words.append(len(text))
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edges[::2], edges[1::2])])
                kept.append(b" ".join(compress(text, ~own) if len(edges) else text).decode("utf-8", "replace"))
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, span), "kept_text": pa.array(kept, pa.string())})

    by_block = dealt.groupBy("block")
    anchors = _repeated(by_block.applyInArrow(send_anchors, _PARTS), 1)
    windows_ = _repeated(by_block.cogroup(anchors.groupBy("block")).applyInArrow(send_windows, _PARTS), 2)
    answers = anchors.withColumn("lanes", F.lit(1)).unionByName(windows_.withColumn("lanes", F.lit(2)))
    result = "doc_id long, n_words long, spans array<struct<first: long, last: long>>, kept_text string"
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(mark, result)
