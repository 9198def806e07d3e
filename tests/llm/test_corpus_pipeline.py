"""The pipeline over a small table: every stage's decisions are those of its operator, and what comes out packs what is left."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from gleaner.llm.common import settle
from gleaner.llm.decontaminate import drop_leaks
from gleaner.llm.near_dups import keep_one_of_each
from gleaner.llm.quality import classify_quality, keep_good

FOLDER = "/root/testdata/sf0.01"


CLEAN = "A calm morning by the river, with notes on how the old mill was built and who kept it running through {} long winters of snow."


def test_rows_are_judged_by_id_and_text(spark):
    """Null ids are judged like others, and a clean text stays where its id repeats with one that goes."""
    items = spark.createDataFrame([(1, "which planet of the solar system has the largest number of moons today"), (2, "Yes")], "item_id long, text string")
    leak = "Question seven asks which planet of the solar system has the largest number of moons today and why."
    rows = [(1, CLEAN.format(1)), (1, leak), (None, leak), (None, CLEAN.format(2)), (2, "I said yes."), (3, "yes"), (4, None)]
    docs = spark.createDataFrame([(i, t, 7, 1) for i, t in rows], "doc_id long, text string, n_words int, row int")
    left = drop_leaks(docs, items)
    assert left.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [(1, CLEAN.format(1)), (None, CLEAN.format(2)), (2, "I said yes."), (4, None)]))

    words = [f"w{i}" for i in range(60)]
    base, near, other = " ".join(words), " ".join([*words, "end"]), " ".join(words[::-1])
    rows = [(5, base), (5, other), (None, near), (9, near), (None, None), (7, other + " tail"), (8, "short")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    left = keep_one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [(5, base), (5, other), (None, None), (8, "short")]))


def test_quality_needs_evidence(spark):
    docs = spark.createDataFrame([(k, CLEAN.format(k), "s", "en") for k in range(40)] + [(None, CLEAN.format(99), "s", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert keep_good(docs, labels).count() == 41
    # Labels of one target alone reject for that target alone.
    assert keep_good(docs, spark.createDataFrame([(k, 1, None) for k in range(40)], "doc_id long, quality int, toxic int")).count() == 41


def test_half_of_a_label_counts(spark):
    """Where every second id has no toxicity, the quality is learnt from all rows as before."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    half = labels.withColumn("toxic", F.when(F.col("doc_id") % 2 == 0, F.col("toxic")))
    whole, part = (classify_quality(docs, own).select("doc_id", "text_bad", "bad", "host_rate") for own in (labels, half))
    joined = whole.join(part.toDF("doc_id", "text_bad2", "bad2", "host_rate2"), "doc_id")
    # Which words are features depends on both targets, so the text's own probability may move a little; the rates may not.
    assert joined.where("abs(host_rate - host_rate2) > 1e-12").count() == 0
    assert joined.where("(bad < 0.5) <> (bad2 < 0.5)").count() <= 10


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, FOLDER))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    texts = [" ".join(r.text.split()) for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    bad = [r.doc_id for r in docs.collect() if labels.get(r.doc_id, (1, 0)) != (1, 0)]
    assert len(bad) < 0.02 * len(labels)
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    used = defaultdict(int)
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= sum(used.values()) / 2048 * 1.02 + 2
