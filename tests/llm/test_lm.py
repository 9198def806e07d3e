from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gleaner.llm.lm import FREQUENT, GROUPS, OUTPUTS, LogBilinear, contexts, score_documents

FOLDER = "/root/testdata/sf0.01"


def brute(rows):
    tokens = [(i, [*(t or "").encode().lower().split(), b""], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    count = Counter(w for _, words, held in tokens if not held for w in words)
    n, v = sum(count.values()), len(count)
    return [(i, held, len(words), sum(count[w] > 0 for w in words), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)) for i, words, held in tokens]


def agree(docs, found):
    wanted = sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=lambda r: (r[0] is None, r[0], r[2]))
    rows = sorted(map(tuple, found), key=lambda r: (r[0] is None, r[0], r[2]))
    assert [r[:5] for r in rows] == [r[:5] for r in wanted]
    assert np.allclose([r[5] for r in rows], [r[5] for r in wanted], rtol=1e-9)
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in rows)


@pytest.fixture(scope="module")
def scored(spark):
    return score_documents(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()


def test_counts_and_base(spark, scored):
    agree(spark.read.parquet(f"{FOLDER}/documents.parquet"), scored)


def test_model_beats_counts_on_held_out_text(scored):
    held = [r for r in scored if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.1


def test_odd_rows(odd_docs, no_docs):
    agree(odd_docs, score_documents(odd_docs).collect())
    assert score_documents(no_docs).count() == 0


def test_probabilities_add_up():
    draw = np.random.default_rng(1)
    noise = draw.random(OUTPUTS)
    model = LogBilinear(noise / noise.sum())
    model.out = draw.normal(0, 1, model.out.shape).astype(np.float32)
    for one, two in ((0, 0), (5, 1000)):
        total = 0.0
        for true in range(OUTPUTS):
            total += 10 ** model.log10(np.array([two, one, true]), np.array([0, 3]))[2]
        assert abs(total - 1) < 1e-3


def test_training_learns_a_pattern():
    model = LogBilinear(np.full(OUTPUTS, 1 / OUTPUTS))
    ids = np.tile([1, 2, 3], 4000)
    begin = np.array([0, len(ids)])
    before = model.log10(ids, begin).mean()
    one, two = contexts(ids, begin)
    model.train(((one[k : k + 2048], two[k : k + 2048], ids[k : k + 2048]) for k in range(0, len(ids), 2048)), 0)
    assert model.log10(ids, begin).mean() > before + 1
    assert FREQUENT + GROUPS == OUTPUTS


def test_contexts_start_with_the_end():
    one, two = contexts(np.array([7, 8, 9, 4, 0]), np.array([0, 3, 3, 5]))
    assert one.tolist() == [0, 7, 8, 0, 4] and two.tolist() == [0, 0, 7, 0, 0]
