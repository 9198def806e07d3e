"""Best-fit packing of documents into token sequences, after a dominance reduction."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import part_of, prepare, settle, texts, width

#: Words, and runs of letters, that a worker remembers (about 300 MB together).
CACHED_WORDS, CACHED_RUNS = 1_200_000, 400_000
#: Characters below this one have no composed forms and are the same letters in every version of Unicode.
_OTHER = re.compile("[^\x00-\u024f]")
_ENCODERS: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Ids by word; a missing word is encoded and kept."""

    def __init__(self, code: Encoder, items: Iterable[tuple[bytes, bytes]] = ()):
        super().__init__(items)
        self.word_ids = code.word_ids

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = self.word_ids(word)
        return found


class Encoder:
    """Token ids of texts, as packed unsigned 32-bit numbers, with the words met so far remembered.

    Holds for tokenizers that drop white space: a text's ids are then those of its white-space-separated words, one after another. Where
    the tokenizer splits words by one pattern before it merges bytes, and lower-cases, a new word of plain letters is split here, and only
    runs that are new, too, go to the merges; all other words go through the whole tokenizer. A full memory loses its older half; frequent
    words are back at once.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(file):
            import public_tokenizers

            file = public_tokenizers.path(file)
        self.tokenizer = Tokenizer.from_file(file)
        # Where the tokenizer lower-cases all text itself, words that differ in case alone are remembered once.
        self.folds = "Lowercase()" in str(self.tokenizer.normalizer)
        self.pattern = self._word_pattern(json.loads(self.tokenizer.to_str()))
        self.letters = _byte_letters()
        self.known = _Words(self)
        self.runs: dict[str, bytes] = {}

    def _word_pattern(self, spec: dict) -> regex.Pattern | None:
        """The pattern whose matches are merged one by one, for tokenizers that do nothing else to a lower-case word of plain letters."""
        steps = [(n["type"], n.get("pattern"), n.get("content")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = steps == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
        if not plain or len(cuts) != 2 or spec["model"]["type"] != "BPE" or spec["model"]["dropout"]:
            return None
        split, level = cuts
        splits = split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and "Regex" in split["pattern"]
        levels = level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"]
        return regex.compile(split["pattern"]["Regex"]) if splits and levels else None

    def _new_run(self, run: str) -> bytes:
        if len(self.runs) > CACHED_RUNS:
            self.runs = dict(islice(self.runs.items(), CACHED_RUNS // 2, None))
        shown = run if run.isascii() and run.isprintable() else "".join(map(self.letters.__getitem__, run.encode()))
        found = self.runs[run] = array("I", [token.id for token in self.tokenizer.model.tokenize(shown)]).tobytes()
        return found

    def _run_ids(self, run: str) -> bytes:
        return self.runs.get(run) or self._new_run(run)

    def word_ids(self, word: bytes) -> bytes:
        """The ids of a word that is not remembered."""
        if self.pattern and b"<|" not in word:
            text = word.decode().lower()
            if not _OTHER.search(text):
                if text.isalpha():
                    return self._run_ids(text)
                if text[:-1].isalpha():
                    return self._run_ids(text[:-1]) + self._run_ids(text[-1])
                return b"".join(map(self._run_ids, self.pattern.findall(text)))
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        if len(self.known) > CACHED_WORDS:
            self.known = _Words(self, islice(self.known.items(), CACHED_WORDS // 2, None))
        # Special tokens are found before lower-casing, so a text that may hold one keeps its case.
        words = (text.lower() if self.folds and b"<|" not in text else text).split()
        return b"".join(map(self.known.__getitem__, words))


def encoder(file: str) -> Encoder:
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, on demand, ``ids`` (packed little-endian).

    A document's ids are those of its text, then ``end_id``; only documents over ``capacity`` are cut. A null or empty text is the
    end id alone. Nothing is shuffled.
    """
    prepare(docs.sparkSession)
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        code = encoder(tokenizer)
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = code.encode(text.as_buffer().to_pybytes()) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for col, value in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        col.append(value)
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays[: 6 if keep_ids else 5], names[: 6 if keep_ids else 5])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return texts(docs, id_col).select("doc_id", F.encode("text", "utf-8").alias("text")).mapInArrow(cut, schema)


def _best_pair(lengths: np.ndarray, counts: np.ndarray, room: int) -> int:
    """The largest sum of two of the items that is not over ``room``; 0 if there is none."""
    low, high, best = 0, len(lengths) - 1, 0
    while low <= high:
        total = int(lengths[low] + lengths[high])
        if total > room or (low == high and counts[low] < 2):
            high -= 1
        else:
            best, low = max(best, total), low + 1
    return best


def reduce_bins(counts: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Dominance reduction: bins that some best packing holds; ``counts`` (items by length) loses their items.

    An item's bin is fixed when one partner is as good as anything else that could stand beside it: no other item fits; the
    partner fills the bin to the brim; no two others fit together, and the partner is the largest that fits; or no three fit, and
    the partner is as large as the best pair. In all these cases whatever else shares the item's bin could take the partner's place
    elsewhere, so fixing costs no bin. Equal items are fixed together: the conditions still hold when items are gone.
    """
    bins = []
    for length in range(capacity, 0, -1):
        while counts[length]:
            room = capacity - length
            counts[length] -= 1
            rest = np.flatnonzero(counts)
            there = counts[rest].copy()
            counts[length] += 1
            fitting = rest[rest <= room]
            if not len(fitting):
                bins.append((((length, 1),), int(counts[length])))
                counts[length] = 0
                break
            partner = int(fitting[-1])
            smallest = np.repeat(rest[:3], np.minimum(there[:3], 3))[:3]
            if partner != room and not (len(smallest) < 2 or smallest[:2].sum() > room):
                three = len(smallest) < 3 or smallest.sum() > room
                if not three or _best_pair(fitting, there[: len(fitting)], room) > partner:
                    break
            times = int(counts[length] // 2 if partner == length else min(counts[length], counts[partner]))
            if not times:
                break
            counts[length] -= times
            counts[partner] -= times
            bins.append((((length, 2),) if partner == length else ((length, 1), (partner, 1)), times))
    return bins


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Best fit of all items, longest first; bins with equal contents are one entry with their number.

    Equal items go together: the tightest bins that take the length are filled with as many as they hold, which is what
    best fit does one by one. A length splits at most one entry and adds at most two, so there are at most three entries for each length.
    """
    by_room: dict[int, list] = defaultdict(list)
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            rooms = [r for r, groups in by_room.items() if r >= length and groups]
            room, (content, number) = (min(rooms), by_room[min(rooms)].pop()) if rooms else (capacity, ((), 0))
            each = room // length
            number = number or max(1, left // each)
            take = min(each, left)
            used = min(number, left // take)
            if used < number and content:
                by_room[room].append((content, number - used))
            by_room[room - take * length].append((content + ((length, take),), used))
            left -= take * used
    return [group for groups in by_room.values() for group in groups]


def plan_slots(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Where the items of each length go: rows of length, first rank, end rank, first sequence, copies per sequence, first offset.

    Items of a length are numbered; those from first to end rank fill ``copies`` places, one after another, in each sequence.
    """
    items = np.zeros(capacity + 1, np.int64)
    for length, number in counts.items():
        items[length] = number
    groups = reduce_bins(items, capacity)
    groups += best_fit(items, capacity)
    ranks, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for content, number in groups:
        offset = 0
        for length, copies in content:
            end = ranks[length] + copies * number
            rows.append((length, ranks[length], end, sequence, copies, offset))
            ranks[length], offset = end, offset + copies * length
        sequence += number
    return np.array(rows, np.int64).reshape(-1, 6)


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, length``.

    What the packing needs of the corpus is how many pieces there are of each length: at most ``capacity`` numbers, counted map-side,
    and the plan made from them has at most a few entries for each length, however large the corpus is. Each piece then finds
    its place by its rank among those of its length. Ranks are dealt out in parts (by hash), each numbered on its own and shifted by the
    counts of the parts before, so a length that most pieces share is not one task's work.
    """
    spark = pieces.sparkSession
    prepare(spark)
    parts = 4 * width(spark)
    kept = pieces.columns
    placed = pieces.withColumn("part", part_of("doc_id", "piece", parts=parts))
    per_part = settle(placed.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    counts = {row["length"]: row["n"] for row in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan_slots(counts, capacity)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    shared = spark.sparkContext.broadcast(slots)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    shifts = per_part.select("length", "part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))
    ranked = placed.withColumn("rank", rank - 1).join(shifts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        base = 1 << 44
        keys = table[:, 0] * base + table[:, 1]
        for batch in batches:
            length, ranks = (np.asarray(batch.column(name), np.int64) for name in ("length", "rank"))
            row = table[np.searchsorted(keys, length * base + ranks, side="right") - 1]
            within = ranks - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in kept] + [pa.array(row[:, 3] + within // row[:, 4]), pa.array(row[:, 5] + within % row[:, 4] * length)],
                [*kept, "sequence_id", "offset"],
            )

    schema = ranked.select(*kept).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*kept, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Token pieces of the documents with their place: the columns of ``token_pieces``, ``sequence_id`` and ``offset``.

    Every sequence has at most ``capacity`` tokens and no gap from offset 0. Null and empty texts are packed as an end id.
    Repeated rows and ids are packed each for itself; null ids too. An empty table gives no rows. Other columns are not read.
    """
    return pack_pieces(settle(token_pieces(docs, tokenizer, capacity, end_id, keep_ids, id_col)), capacity)
