from __future__ import annotations

import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gleaner.llm.packing import best_fit, pack_documents, plan_slots, reduce_bins

NAME = "word_bpe_49k.json"


def _check(docs, capacity=2048):
    code = Tokenizer.from_file(public_tokenizers.path(NAME))
    rows = pack_documents(docs, NAME, capacity).collect()
    wanted = defaultdict(list)
    for r in docs.collect():
        ids = [*code.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            wanted[r.doc_id].append((k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    found, places = defaultdict(list), defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in wanted.items()}
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places), sum(r.length for r in rows)


def test_pieces_agree_with_the_tokenizer(spark, odd_docs, no_docs):
    sequences, tokens = _check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sequences <= -(-tokens // 2048) + 1
    _check(odd_docs)
    assert pack_documents(no_docs, NAME).count() == 0


def test_special_tokens_and_case(spark):
    texts = ["a<|endoftext|>b", "A<|ENDOFTEXT|>B", "x <|startoftext|> Y", "İstanbul Ǆ ﬁ é é \u0301x"]
    _check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8)


def test_words_learnt_by_runs_agree_with_the_tokenizer(monkeypatch):
    """Every word of a table, and words of signs, digits and letters of all kinds, with memories that overflow."""
    from gleaner.llm import packing

    monkeypatch.setattr(packing, "CACHED_WORDS", 2000)
    monkeypatch.setattr(packing, "CACHED_RUNS", 500)
    code, plain = packing.Encoder(NAME), Tokenizer.from_file(public_tokenizers.path(NAME))
    assert code.pattern
    rng = random.Random(2)
    signs = "abcxyz'sdlmrvteABZ019.,;!?-_<|>&%$\"()éÉßñœŒŁłſǅɏɐİıςΣжЖ中文한ไ²½٣\u0301\u200b\ufeff\x7f😀"
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 9))) for _ in range(20_000)]
    texts += ["it's", "we'll've", "'s", "o''ss", "A1B2", "x" * 5000, "1" * 300, "naïve-café", "<|endoftext|>", "a<|startoftext|>B", "<|x"]
    import pandas as pd

    texts += pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.tolist()
    for at in range(0, len(texts), 40):
        text = " ".join(texts[at : at + 40])
        assert np.frombuffer(code.encode(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def _fewest(items, capacity):
    """Fewest bins by trying everything."""

    @cache
    def solve(left):
        if not left:
            return 0
        first, rest = left[-1], left[:-1]
        best = 1 + len(rest)

        def fill(k, room, taken):
            nonlocal best
            if k < 0:
                best = min(best, 1 + solve(tuple(x for i, x in enumerate(rest) if i not in taken)))
                return
            if rest[k] <= room:
                fill(k - 1, room - rest[k], taken | {k})
            fill(k - 1, room, taken)

        fill(len(rest) - 1, capacity - first, frozenset())
        return best

    return solve(tuple(sorted(items)))


def test_reduction_costs_no_bin():
    random.seed(3)
    for _ in range(60):
        capacity = random.choice([10, 13, 20])
        items = [random.randint(1, capacity) for _ in range(random.randint(1, 8))]
        counts = np.bincount(items, minlength=capacity + 1)
        fixed = sum(n for _, n in reduce_bins(counts, capacity))
        rest = [length for length, n in enumerate(counts) for _ in range(n)]
        assert fixed + _fewest(rest, capacity) == _fewest(items, capacity)


def test_slots_hold_every_item():
    random.seed(5)
    for _ in range(30):
        capacity = random.choice([16, 64, 256])
        counts = {n: random.randint(1, 400) for n in random.sample(range(1, capacity + 1), random.randint(1, 16))}
        rows = plan_slots(counts, capacity)
        used = defaultdict(list)
        for length, low, high, sequence, copies, offset in rows.tolist():
            for rank in range(low, high):
                used[sequence + (rank - low) // copies].append((offset + (rank - low) % copies * length, length))
        assert sum(map(len, used.values())) == sum(counts.values())
        for parts in used.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= capacity
        assert len(used) <= 1.25 * (sum(k * n for k, n in counts.items()) / capacity) + 1 or max(counts) > capacity // 3


def test_best_fit_fills_the_tightest_bin():
    counts = np.zeros(11, np.int64)
    counts[[7, 6, 4, 3]] = 1
    assert sorted(n for _, n in best_fit(counts, 10)) == [1, 1]
