"""Operators against plain loops on small random inputs, and against hand-made rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gleaner import constants
from gleaner.operators import dedupe, ingest, spillover, taxonomy
from gleaner.operators.geo import match_country_state_ids
from gleaner.operators.mentions import first_mention
from gleaner.operators.ranking import global_position, top_n


def test_top_n_small_and_large_limits_agree(spark):
    # One group holds most rows; the large limit takes the salted way.
    rows = spark.range(6000).select(F.when(F.col("id") < 5000, F.lit("hot")).otherwise(F.lit("cold")).alias("k"), F.xxhash64("id").alias("o"))
    found = {r.k: r.n for r in top_n(rows, "k", "o", 2500).groupBy("k").count().withColumnRenamed("count", "n").collect()}
    assert found == {"hot": 2500, "cold": 1000}
    largest = top_n(rows, "k", "o", 2500, "rank").filter("k = 'hot'").agg(F.max("o")).first()[0]
    assert largest == sorted(r.o for r in rows.filter("k = 'hot'").collect())[2499]


def test_global_position(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(700)).alias("o"), "id").repartition(5)
    found = global_position(rows, ["o", "id"], "n").orderBy("n").collect()
    assert [r.n for r in found] == list(range(1, 5001))
    assert [(r.o, r.id) for r in found] == sorted((r.o, r.id) for r in found)


def test_a_page_sorts_only_its_range(spark, monkeypatch):
    """Ranges with few rows are left for pages anywhere, with a key that most rows share, descending, with nulls and repeated rows."""
    from gleaner.operators import paging
    from gleaner.sources import sinks

    monkeypatch.setattr(paging, "SORTED_ROWS", 150)
    monkeypatch.setattr(paging, "SAMPLE_ROWS", 400)
    draw = random.Random(6)
    rows = [(draw.choice(["same"] * 6 + [None, "a", "é", "Zz", "z", f"k{i}"]), f"id{i}") for i in range(5000)]
    frame = spark.createDataFrame(rows, "t string, id string").repartition(7)
    order = [(sinks.sort_key("t"), False), (F.col("id"), False)]
    for first in (0, 2000, 4990):
        part, before = paging.narrowed(frame, order, first, first + 9, 5000)
        held = part.count()
        assert held <= 400 and before <= first and first + 9 < before + held
    for descending in (False, True):
        whole = [r.id for r in sinks.sort_by_field(frame, "t", descending).collect()]
        for page in (37, 500) if descending else (1, 260):
            found = sinks.page_of(frame, page, "t", descending).collect()
            assert [r.id for r in found] == whole[(page - 1) * 10 : page * 10] and {r.total_pages for r in found} == {500}
    assert sinks.page_of(frame, 501, "t").count() == 0
    same = spark.range(400).select(F.lit("x").alias("t"), F.lit("y").alias("id"))
    assert sinks.page_of(same, 40, "t").count() == 10 and sinks.page_of(same.limit(0), 1, "t").count() == 0


def _spill(candidates, n):
    saved, seen = [], set()
    for feed in sorted({c[0] for c in candidates}):
        own = sorted((pos, key) for f, key, pos in candidates if f == feed and key not in seen)
        for pos, key in own[:n]:
            saved.append((feed, key, pos))
            seen.add(key)
    return sorted(saved)


def test_cap_with_spillover_equals_the_sequential_run(spark):
    draw = random.Random(7)
    for case in range(4):
        feeds, keys, n = draw.randint(1, 6), draw.randint(3, 25), draw.randint(1, 5)
        pairs = {(f, f"u{k}") for f in range(feeds) for k in range(keys) if draw.random() < 0.6}
        candidates = [(f, k, p) for p, (f, k) in enumerate(draw.sample(sorted(pairs), len(pairs)))]
        frame = spark.createDataFrame(candidates or [(0, "u0", 0)], "feed int, key string, pos int")
        found = spillover.cap_with_spillover(frame, ["feed"], "key", "pos", n).select("feed", "key", "pos").collect()
        assert sorted(map(tuple, found)) == _spill(candidates or [(0, "u0", 0)], n), case


def test_cap_with_spillover_example(spark):
    first = [(1, f"u{i}", i) for i in range(1, 13)]
    second = [(2, "u11", 1), (2, "u12", 2), (2, "u13", 3), (2, "u1", 4)]
    frame = spark.createDataFrame(first + second, "feed int, key string, pos int")
    found = sorted(tuple(r) for r in spillover.cap_with_spillover(frame, ["feed"], "key", "pos", 10).select("feed", "key").collect())
    assert found == sorted([(1, f"u{i}") for i in range(1, 11)] + [(2, "u11"), (2, "u12"), (2, "u13")])


def test_cap_with_spillover_carries_only_what_was_turned_away(spark, monkeypatch):
    """Twenty feeds, keys that up to fourteen of them list, and one key that all list, with parts that are merged and options that run out."""
    monkeypatch.setattr(spillover, "PARTS", 4)
    monkeypatch.setattr(spillover, "OPTIONS", 6)
    draw = random.Random(11)
    pairs = {(f, f"u{k}") for k in range(250) for f in draw.sample(range(20), draw.choice([1, 2, 3, 14]))} | {(f, "u-all") for f in range(20)}
    candidates = [(f, k, p) for p, (f, k) in enumerate(draw.sample(sorted(pairs), len(pairs)))]
    rounds = []
    found = spillover.cap_with_spillover(spark.createDataFrame(candidates, "feed int, key string, pos int"), ["feed"], "key", "pos", 7, rounds)
    assert sorted(map(tuple, found.select("feed", "key", "pos").collect())) == _spill(candidates, 7)
    asked, written = [a for a, _ in rounds], [w for _, w in rounds]
    assert len(rounds) > spillover.PARTS and asked == sorted(asked, reverse=True) and asked[0] == 251
    # A key that was let in and is pushed out is written once more; nothing else is.
    assert all(w <= a + (rounds[i - 1][1] if i else 0) for i, (a, w) in enumerate(rounds)) and sum(written) < 2 * sum(asked)


def test_cap_with_spillover_of_odd_rows(spark):
    rows = [(None, "a", 1), (None, "b", 2), (1, "b", 0), (1, "", 0), (1, None, 0), (2, "b", 9), (2, "b", 3), (2, "c", None)]
    frame = spark.createDataFrame(rows, "feed int, key string, pos int")
    found = spillover.cap_with_spillover(frame, ["feed"], "key", "pos", 1)
    assert sorted(map(str, map(tuple, found.select("feed", "key", "pos").collect()))) == ["(1, 'b', 0)", "(2, 'c', None)", "(None, 'a', 1)"]
    assert spillover.cap_with_spillover(frame.limit(0), ["feed"], "key", "pos").columns == ["feed", "key", "pos"]


def test_buffer_links_stops_between_chunks(spark):
    rows = [(1, chunk, pos, f"u{chunk}-{pos}") for chunk in range(4) for pos in range(9)]
    rows += [(2, 0, 0, "a"), (2, 1, 0, "a"), (2, 1, 1, "b")]
    frame = spark.createDataFrame(rows, "listing_id int, chunk_no int, place int, url string")
    found = {r.listing_id: r.n for r in ingest.buffer_links(frame, 1).groupBy("listing_id").agg(F.count("*").alias("n")).collect()}
    # 13 wanted: chunk 0 gives 9, so chunk 1 is read whole, and then none.
    assert found == {1: 18, 2: 2}


def test_anti_join_splits_the_input(spark):
    rows = spark.createDataFrame([(i, f"https://h.com/{i % 7}?x={i}") for i in range(30)], "i int, url string")
    known = spark.createDataFrame([("https://h.com/3#a",), ("",)], "source_url string")
    kept = dedupe.anti_known(rows, known)
    assert kept.count() == sum(1 for i in range(30) if i % 7 != 3)
    assert dedupe.anti_known_raw(rows, known).count() == 30


def test_prefer_larger_run_keeps_the_first_on_a_tie(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("a", 2), ("b", 1), ("b", 2), ("b", 2)]
    found = ingest.prefer_larger_run(spark.createDataFrame(rows, "l string, run int"), "l", "run").distinct().collect()
    assert sorted(map(tuple, found)) == [("a", 1), ("b", 2)]


def test_explode_feeds_skips_what_it_cannot_use(spark):
    configs = [
        ("1", "m1", '{"feeds":[{"url":"https://a","fields":{"location":true}},{"url":""},{"url":"https://b"}]}'),
        ("2", None, '{"feeds":[{"url":"https://c"}]}'),
        ("3", "m3", "not json"),
        ("4", "m4", "[1]"),
        ("5", "m5", "{}"),
    ]
    found = ingest.explode_feeds(spark.createDataFrame(configs, "id string, micrositeId string, config string")).collect()
    assert [(r.config_id, r.feed_pos, r.feed_url, r.filter_location) for r in found] == [("1", 0, "https://a", True), ("1", 2, "https://b", False)]


CATEGORIES = [("1", "Trades", None), ("2", "Welding", "1"), ("3", "Geology", "1"), ("4", "Other", "1"), ("5", "Test", "1")]


def _categories(spark, rows=None):
    return spark.createDataFrame(CATEGORIES if rows is None else rows, "id string, name string, parent_id string")


def test_assign_category(spark):
    jobs = [
        (1, "test job", "", "", ""), (2, "Senior welder", "welding and geology", "", ""), (3, "Cook", "", "2", ""),
        (4, "Cook", "", "", "GEOLOGY"), (5, "Cook", "", "1", ""),
    ]
    frame = spark.createDataFrame(jobs, "i int, job_title string, job_description string, category_id string, category_name string")
    found = {r.i: (r.category_id, r.category_name) for r in taxonomy.assign_category(frame, _categories(spark)).collect()}
    assert found == {1: ("5", "Test"), 2: ("3", "Geology"), 3: ("2", "Welding"), 4: ("3", "Geology"), 5: ("4", "Other")}
    nothing = taxonomy.assign_category(frame, _categories(spark, [])).select("category_id").distinct().collect()
    assert [r.category_id for r in nothing] == [""]


def test_mentions_equal_a_plain_search(spark):
    """Names from one letter on, letters of several bytes, texts that repeat, are empty or null, and names that are patterns."""
    draw = random.Random(3)
    words = ["".join(draw.choices("ab cé😀.", k=draw.randint(1, 9))).strip() or "a" for _ in range(80)] + ["a.", "(", "\\e"]
    texts = ["".join(draw.choices("ab cé😀.", k=draw.randint(0, 40))) for _ in range(80)] * 2 + ["", "\n(", "x\\e"]
    rows = [("p", "parent", None)] + [(str(i), word, "p") for i, word in enumerate(words)]
    frame = spark.createDataFrame([*enumerate(texts), (999, None)], "i int, t string")
    ordered = sorted((word.encode(), str(i)) for i, word in enumerate(words))
    expected = {i: next((key for word, key in ordered if word in text.encode()), None) for i, text in enumerate(texts)} | {999: None}
    selectable = taxonomy.selectable_categories(_categories(spark, rows))
    found = taxonomy.match_category_mention(frame, selectable, F.col("t")).collect()
    assert len(found) == len(expected) and {r.i: r.mentioned and r.mentioned.id for r in found} == expected
    some = taxonomy.match_category_mention(frame, selectable, F.col("t"), where=F.col("i") % 2 == 0).collect()
    assert {r.i: r.mentioned and r.mentioned.id for r in some} == {i: None if i % 2 else key for i, key in expected.items()}
    none = taxonomy.match_category_mention(frame, selectable.limit(0), F.col("t"))
    assert none.count() == len(expected) and none.filter("mentioned is not null").count() == 0


def test_mention_index_has_one_rare_gram_for_each_name(spark):
    from gleaner.operators.mentions import mention_index

    names = spark.createDataFrame([("welding shop", 3), ("welding shop", 1), ("welding", 2), ("ab", 4), ("", 5)], "lname string, place int")
    found = {r.lname: (r.gram, r.place) for r in mention_index(names).collect()}
    # The grams of "welding" are all in both names, those across the space in one.
    assert found == {"welding shop": (" shop", 1), "welding": ("eldin", 2), "ab": ("ab", 4)}


def test_flat_category_table_falls_back_to_all_active_rows(spark):
    rows = spark.createDataFrame([("1", "A", "true"), ("2", "B", "No"), ("", "C", "true")], "uuid string, label string, enabled string")
    assert [r.name for r in taxonomy.selectable_categories(rows).collect()] == ["A"]
    assert taxonomy.category_prompt(_categories(spark, [])).first().prompt == constants.NO_CATEGORIES_TEXT


def test_geo_ids(spark):
    tree = [(1, "Canada", "CA", None), (2, "United States", "US", None), (3, "Ontario", "ON", 1), (4, "Nevada", "NV", 2)]
    dim = spark.createDataFrame(tree, "id int, name string, code string, parent_id int")
    places = [("Ontario", "Canada"), ("Nevada", ""), ("Nevada", "Canada"), ("", "usa"), ("x", "y")]
    found = match_country_state_ids(spark.createDataFrame(places, "state string, country string"), dim).collect()
    ids = {(r.state, r.country): (r.state_id, r.country_id) for r in found}
    assert ids == {
        ("Ontario", "Canada"): ("3", "1"), ("Nevada", ""): ("4", "2"), ("Nevada", "Canada"): (None, "1"), ("", "usa"): (None, "2"), ("x", "y"): (None, None),
    }


def test_many_names_are_not_sent_whole(spark):
    # Their file is far below the size up to which Spark sends a table to all tasks.
    names = spark.range(60_000).select(F.format_string("%010d-%06d", F.col("id") % 6_000, F.col("id")).alias("lname"), F.col("id").alias("place"))
    texts = spark.range(3).select(F.col("id").alias("key"), F.format_string("fits %010d-%06d of it", "id", F.col("id") + 6_000).alias("text"))
    found = first_mention(texts, names)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [(0, 6_000), (1, 6_001), (2, 6_002)]
    few = first_mention(texts, names.filter("place in (6000, 6001)"))
    assert sorted(tuple(r) for r in few.collect()) == [(0, 6_000), (1, 6_001)]


def test_many_names_are_cut_to_those_that_texts_may_hold(spark):
    from gleaner.operators.mentions import mention_index

    words = [f"{'äb'[i % 2]}{i * 7919 % 1_000_003:06d}-{i % 83}" for i in range(12_000)] + ["é-4", "x", "zz"]
    names = spark.range(12_003).select(F.element_at(F.lit(words), (F.col("id") + 1).cast("int")).alias("lname"), F.lit("p" * 100).alias("unused"), F.col("id").alias("place"))
    ends = [*words[5:12_000:1_500], "é-4", "x1"]
    rows = [(i, ("filler " * (7 * i) + ends[i % len(ends)] + "9 tail")) for i in range(40)] + [(99, ""), (98, "none"), (97, None)]
    texts = spark.createDataFrame(rows + rows[:5], "key int, text string")
    expected = {key: min((at for at, word in enumerate(words) if word in (text or "")), default=None) for key, text in rows}
    found = first_mention(texts, names).collect()
    assert {r.key: r.place for r in found} == {key: at for key, at in expected.items() if at is not None} and len(found) == 40
    # A gram of five letters would stand for many of so many names.
    assert mention_index(names).filter(F.length("lname") > 6).agg(F.min(F.length("gram"))).first()[0] == 6
