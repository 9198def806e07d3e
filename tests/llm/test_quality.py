from __future__ import annotations

import numpy as np

from gleaner.llm.quality import _choose, classify_quality, keep_good, shrunk_rates


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    judged = classify_quality(docs, labels).join(labels.withColumnsRenamed({"toxic": "is_toxic"}), "doc_id").where("held_out").collect()
    bad, toxic = [r for r in judged if r.quality == 0], [r for r in judged if r.is_toxic == 1]
    clean = [r for r in judged if r.quality == 1 and r.is_toxic == 0]
    assert min(len(bad), len(toxic), len(clean)) > 50
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)
    assert sum(not r.kept for r in toxic) >= 0.95 * len(toxic)
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)


def test_rates_shrink_by_evidence(spark):
    rows = [("a", "x", int(k < 80)) for k in range(100)] + [("b", "x", int(k < 5)) for k in range(100)] + [("c", "x", 1)] + [("a", "y", 0), ("b", "y", 0)]
    rates = {(r.host, r.path): r for r in shrunk_rates(spark.createDataFrame(rows, "host string, path string, bad int"), "bad").collect()}
    assert rates["a", "x"].path_rate > 0.7 and rates["b", "x"].path_rate < 0.1
    assert rates["a", "x"].global_rate < rates["c", "x"].path_rate < 0.9  # one document moves a site a little
    assert rates["b", "y"].path_rate < rates["a", "y"].path_rate < rates["a", "y"].host_rate


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (2, 1, 1), (6, 0, 0), (99, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    found = classify_quality(odd_docs, labels)
    assert found.count() == odd_docs.count() and found.where("kept is null or bad is null or bad <> bad").count() == 0
    assert classify_quality(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert classify_quality(no_docs, labels).count() == 0
    assert keep_good(odd_docs, labels).columns == odd_docs.columns


def test_toxic_sites_are_evidence(spark):
    """The same text is more likely toxic where most labelled texts are, less so where none are; sites are told apart by path, too."""
    words = ["plain", "mild", "harsh", "crude"]
    rows = [(k, f"{words[k % 4]} words number{k % 7} stand here", "dirty" if k % 2 else "tidy", "x") for k in range(400)]
    rows += [(1000, "plain words stand here", "dirty", "x"), (1001, "plain words stand here", "tidy", "x"), (1002, "plain words stand here", "new", "x")]
    labels = [(k, 1, int(k % 2 == 1 and k % 10 != 1)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    judged = {r.doc_id: r for r in classify_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert judged[1000].text_toxic == judged[1001].text_toxic
    assert judged[1001].toxic < judged[1002].toxic < judged[1000].toxic


def test_number_of_words_is_chosen_on_a_fold():
    """Where the hits show only in the second set's words, it is chosen; where both tell the same, the first is."""
    y = (np.arange(200) % 4 == 0).astype(float)
    fold, x, rows = np.arange(200) % 5 == 0, np.ones((200, 1)), np.flatnonzero(y)
    few, many = np.array([True, False]), np.array([True, True])
    assert _choose(x, rows, np.full(len(rows), 1), [few, many], y, fold, 0.5) == 1
    assert _choose(x, rows, np.full(len(rows), 0), [few, many], y, fold, 0.5) == 0
