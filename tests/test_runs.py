"""Sources, sinks, whole runs and streams."""

from __future__ import annotations

import json
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalog import runs
from gleaner.operators.company import company_profile
from gleaner.plans import ingest as ingest_plan
from gleaner.plans import listing
from gleaner.plans.ingest import scheduled_ingest
from gleaner.sources import posts as posts_store
from gleaner.sources import sinks, tables
from gleaner.streaming import ingest as streaming

RUN = datetime(2024, 6, 1, 12)


def test_first_existing_table(spark):
    spark.createDataFrame([("1",)], "id string").createOrReplaceTempView("category")
    assert tables.first_existing_table(spark, ["no_such_table", "category"], "id string").count() == 1
    assert tables.first_existing_table(spark, ["no_such_table"], "id string, name string").columns == ["id", "name"]


def test_split_fetch_results(spark):
    rows = [("home", "u1", 200, "<p>", None), ("about", "u2", 404, "<i>", None), ("contact", "u3", None, None, "timeout")]
    pages, errors = tables.split_fetch_results(spark.createDataFrame(rows, "page string, url string, status_code int, html string, error string"))
    assert {r.page: r.html for r in pages.collect()} == {"home": "<p>", "about": "<i>", "contact": ""}
    assert sorted((r.page, r.status_code, r.error) for r in errors.collect()) == [("about", 404, "HTTP 404"), ("contact", None, "timeout")]


def test_state_round_trip(spark, tmp_path):
    urls = spark.createDataFrame([("https://h.com/1",)], "source_url string")
    records = spark.createDataFrame([("A",)], "job_title string")
    version = sinks.save_state(urls, records, str(tmp_path), RUN)
    loaded_urls, loaded = sinks.load_state(spark, str(tmp_path), version, records.schema)
    assert [r.source_url for r in loaded_urls.collect()] == ["https://h.com/1"]
    assert [(r.job_title, r.saved_at) for r in loaded.collect()] == [("A", RUN)]
    assert sinks.load_state(spark, str(tmp_path), "20000101T000000", records.schema) is None


def test_csv_and_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([("Firm", 'say "hi", now')], "employer string, job_title string")
    path = sinks.export_csv(rows, str(tmp_path), date(2024, 6, 1))
    back = spark.read.option("header", True).option("escape", '"').csv(path).first()
    assert path.endswith("job-results-2024-06-01.csv") and back["Job Title"] == 'say "hi", now' and back["City"] is None
    pages = spark.createDataFrame([("https://h.com/a?b", "<p>")], "url string, html string")
    sinks.snapshot_pages(pages, str(tmp_path / "snap"), "listing", RUN)
    assert spark.read.parquet(str(tmp_path / "snap")).first().file_name == "listing_h.com_a_b_20240601_120000.html"
    with pytest.raises(ValueError):
        sinks.snapshot_pages(pages, str(tmp_path / "snap"), "../x", RUN)


def test_response_json(spark):
    rows = spark.createDataFrame([("A", " ", None, "<p>")], "job_title string, city string, state string, html_content string")
    assert json.loads(sinks.to_response_json(rows).first().json) == {"job_title": "A"}
    assert json.loads(sinks.to_response_json(rows, include_html=True).first().json) == {"job_title": "A", "city": " ", "html_content": "<p>"}


def test_pages_hold_every_row_once(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("string").alias("t"), F.lit("x").alias("tie"))
    for tie in ("id", "tie"):  # the second tells no rows apart
        pages = [sinks.page_of(rows, page, "t", tie=tie).collect() for page in range(1, 11)]
        assert all(len(p) == 10 and p[0].total_pages == 10 for p in pages)
        assert [r.t for p in pages for r in p] == sorted(str(i % 7) for i in range(100))
        assert len({r.id for p in pages for r in p}) == 100
    ordered = sinks.sort_by_field(rows, "t").limit(40).collect()[30:]
    assert [r.id for r in ordered] == [r.id for r in sinks.page_of(rows, 4, "t").collect()]
    assert [r.id for r in sinks.sort_by_field(rows, None).collect()] == [r.id for r in rows.collect()]


def stub_model():
    """A model made inside a function, so that it travels to the executors by value."""

    def open_model():
        def answer(prompt):
            if "BROKEN" in prompt:
                return "sorry"
            if "FAILS" in prompt:
                raise RuntimeError("no answer")
            return json.dumps({"job_title": "Welder", "location": "Reno, NV", "perks_and_benefits": ["a", None]})

        return answer

    return open_model


def test_listing_run(spark):
    html = "".join(f'<a href="/jobs/{i}?ref={i}">j</a>' for i in range(5)) + '<a href="/list#jobs">self</a><a href="/jobs/1">again</a>'
    listings = spark.createDataFrame([(7, "https://h.com/list", html)], "page_id bigint, url string, html string")
    known = spark.createDataFrame([("https://h.com/jobs/3",)], "source_url string")
    links = listing.new_links(listings, known, max_jobs=3)
    assert sorted(r.url for r in links.collect()) == [f"https://h.com/jobs/{i}?ref={i}" for i in (0, 1, 2, 4)]

    body = {0: "<p>ok</p>", 1: "<p>BROKEN</p>", 2: "<p>FAILS</p>", 4: "<p>ok</p>"}
    details = spark.createDataFrame(
        [(7, i, f"https://h.com/jobs/{i}?ref={i}", h) for i, h in body.items()], "listing_id bigint, page_id bigint, url string, html string"
    )
    categories = spark.createDataFrame([("1", "Trades", None), ("2", "Welder", "1")], "id string, name string, parent_id string")
    tree = spark.createDataFrame([(1, "United States", "US", None), (2, "Nevada", "NV", 1)], "id int, name string, code string, parent_id int")
    records = listing.detail_records(details, stub_model(), categories, tree)
    found = {r.page_id: r for r in records.collect()}
    assert (found[0].location, found[0].category_id, found[0].state_id, found[0].country_id) == ("Reno, Nevada, United States", "2", "2", "1")
    assert found[0].perks_and_benefits == "a\nNone"
    assert (found[1].job_title, found[1].job_description, found[2].job_title) == ("", "BROKEN", "Job Title Not Found")
    assert sorted(r.page_id for r in listing.kept_records(records, 2, "page_id").collect()) == [0, 2]
    assert sorted(r.page_id for r in listing.kept_records(records, 5, "page_id", filter_location=True).collect()) == [0, 4]


def test_scheduled_run(spark):
    configs = spark.createDataFrame(
        [("c1", "m1", '{"feeds":[{"url":"https://f1"},{"url":"https://f2","fields":{"location":true}}]}')], "id string, micrositeId string, config string"
    )
    sites = spark.createDataFrame([("m1", "owner")], "id string, userId string")
    links = [("https://f1", f"https://h.com/{i}?a=1", i) for i in range(4)] + [("https://f2", f"https://h.com/{i}", i) for i in range(2, 7)]
    records = [(f"https://h.com/{i}?a=1", "T" if i != 1 else " ", "Reno, NV" if i != 5 else "Lyon") for i in range(7)]
    posts = spark.createDataFrame([("https://h.com/0",)], "source_url string")
    rows, summary = scheduled_ingest(
        configs, sites, spark.createDataFrame(links, "feed_url string, url string, pos int"),
        spark.createDataFrame(records, "source_url string, job_title string, location string"), posts, RUN, n=1,
    )
    assert sorted((r.source_url, r.postedById, r.siteId) for r in rows.collect()) == [
        ("https://h.com/2?a=1", "owner", "m1"), ("https://h.com/3?a=1", "owner", "m1"),
    ]
    totals = [(r.scraped, r.new, r.saved) for r in summary.collect() if r.level == 3]
    # The second feed does not scrape page 2 again, which the first one saved.
    assert totals == [(5, 5, 2)]


def test_counts_of_a_page_in_two_feeds(spark):
    configs = spark.createDataFrame([("10", "m", '{"feeds":[{"url":"https://f2"}]}'), ("9", "m", '{"feeds":[{"url":"https://f1"}]}')], "id string, micrositeId string, config string")
    sites = spark.createDataFrame([("m", "o")], "id string, userId string")
    links = [("https://f1", "https://h.com/a", 0), ("https://f2", "https://h.com/a", 0), ("https://f2", "https://h.com/b", 1)]
    records = [("https://h.com/a", "T", ""), ("https://h.com/b", "T", "")]
    rows, summary = scheduled_ingest(
        configs, sites, spark.createDataFrame(links, "feed_url string, url string, pos int"),
        spark.createDataFrame(records, "source_url string, job_title string, location string"), spark.createDataFrame([], "source_url string"), RUN,
    )
    assert rows.count() == 2
    assert sorted((r.feed_url, r.scraped, r.new, r.saved) for r in summary.collect() if r.level == 0) == [("https://f1", 1, 1, 1), ("https://f2", 1, 1, 1)]


def test_classify_and_update(spark):
    from gleaner.plans.classify import classify_and_update

    def open_model():
        def answer(prompt):
            assert "- id: 2; name: Welding" in prompt
            if "Cook" in prompt:
                return '{"category_id": 3}'
            if "Baker" in prompt:
                return "none of them"
            raise RuntimeError("no answer")

        return answer

    posts = spark.createDataFrame([("a", "Cook", "", None), ("b", "Baker", "", 3), ("c", "Smith", "does welding", None)], "id string, jobTitle string, description string, categoryId int")
    names = [("1", "Trades", None), ("2", "Welding", "1"), ("3", "Food", "1"), ("4", "Other", "1")]
    found = classify_and_update(posts, spark.createDataFrame(names, "id string, name string, parent_id string"), open_model, RUN)
    assert {r.id: r.categoryId for r in found.collect()} == {"a": 3, "b": 4, "c": 2}


def _record(i, title="T", site="m"):
    return (f"https://h.com/{i}?r={i}", title, site, str(i % 3))


RECORD = "source_url string, job_title string, siteId string, category_id string"


def test_append_reads_only_the_buckets_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "posts")
    assert posts_store.append_posts(spark.createDataFrame([_record(i) for i in range(400)], RECORD), path, RUN) == 400
    tables = posts_store.stored_posts(spark, path)
    batch = spark.createDataFrame([_record(5), _record(900)], RECORD)
    ids = posts_store.post_rows(batch, RUN).select("id")
    every, few = tables.files(tables.latest(), "posts"), tables.files(tables.latest(), "posts", ids)
    assert len(every) > 50 and len(few) <= 2
    scan = tables.read("posts", few)
    assert len(scan.inputFiles()) == len(few)
    # The other files can't be read any more, and the append still works: it does not open them.
    for name in set(every) - set(few):
        (tmp_path / "posts" / name).write_bytes(b"no parquet")
    assert posts_store.append_posts(batch, path, RUN) == 1
    assert tables.latest().number == 2


def test_known_pages_do_not_open_posts(spark, tmp_path):
    """Runs of the stream look up stored pages without a look at the posts."""
    path = str(tmp_path / "posts")
    posts_store.append_posts(spark.createDataFrame([_record(i) for i in range(50)], RECORD), path, RUN)
    for name in posts_store.stored_posts(spark, path).latest().files["posts"]:
        (tmp_path / "posts" / name).write_bytes(b"no parquet")
    keys = spark.createDataFrame([("https://h.com/3",), ("https://h.com/999",), ("",), (None,)], "k string")
    assert [r.page for r in posts_store.known_pages(spark, path, keys).collect()] == ["https://h.com/3"]
    plan = posts_store.known_pages(spark, path, keys)
    assert all("/pages/" in name for name in plan.inputFiles())


def test_update_rewrites_only_touched_files(spark, tmp_path):
    path = str(tmp_path / "posts")
    posts_store.append_posts(spark.createDataFrame([_record(i) for i in range(300)], RECORD), path, RUN)
    tables = posts_store.stored_posts(spark, path)
    before = tables.latest()
    ids = [r.id for r in posts_store.read_posts(spark, path).orderBy("id").limit(10).collect()]
    updates = spark.createDataFrame([(i, "77") for i in ids] + [("unknown", "5"), (None, "1"), (ids[0], "no number")], "id string, category_id string")
    assert posts_store.update_posts(spark, path, updates, datetime(2024, 7, 1)) == 10
    after = tables.latest()
    assert after.number == before.number + 1
    assert len(set(before.files["posts"]) - set(after.files["posts"])) <= 10 and before.files["pages"] == after.files["pages"]
    found = posts_store.read_posts(spark, path)
    assert found.count() == 300 and sorted(r.id for r in found.filter("categoryId = 77").collect()) == ids
    assert found.filter("updatedAt = timestamp_ntz'2024-07-01'").count() == 10
    assert posts_store.update_posts(spark, path, updates.limit(0), RUN) == 0 and tables.latest() == after


def test_a_crash_before_publishing_leaves_the_old_version(spark, tmp_path, monkeypatch):
    from gleaner.sources.versions import VersionedTables

    path = str(tmp_path / "posts")
    posts_store.append_posts(spark.createDataFrame([_record(i) for i in range(20)], RECORD), path, RUN)
    updates = posts_store.read_posts(spark, path).select("id", F.lit("9").alias("category_id"))

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(VersionedTables, "publish", fail)
        for step in (lambda: posts_store.update_posts(spark, path, updates, RUN), lambda: posts_store.append_posts(spark.createDataFrame([_record(50)], RECORD), path, RUN)):
            with pytest.raises(RuntimeError):
                step()
    assert posts_store.read_posts(spark, path).count() == 20 and posts_store.read_posts(spark, path).filter("categoryId = 9").count() == 0
    assert posts_store.update_posts(spark, path, updates, RUN) == 20
    assert posts_store.append_posts(spark.createDataFrame([_record(50)], RECORD), path, RUN) == 1


def test_two_writers_and_merged_files(spark, tmp_path):
    path = str(tmp_path / "posts")
    tables = posts_store.stored_posts(spark, path)
    for step in range(3):
        posts_store.append_posts(spark.createDataFrame([_record(i) for i in range(step * 40, step * 40 + 40)], RECORD), path, RUN, buckets=8)
    base = tables.latest()
    merged = tables.merge_files("posts", most=2)
    assert len(base.files["posts"]) > 16 and len(merged.files["posts"]) == 8 and posts_store.read_posts(spark, path).count() == 120
    with pytest.raises(FileExistsError):  # made from a version that is not the last any more
        tables.publish(base, {})
    assert tables.latest() == merged


def test_rows_without_key_do_not_meet_in_one_task(spark):
    from gleaner.operators.dedupe import anti_keys

    rows = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).when(F.col("id") % 4 == 1, F.lit("")).alias("k"))
    known = spark.range(0, 2000, 8).select(F.col("id").cast("string").alias("k"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        found = anti_keys(rows, known, "k").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    sizes = [r["count"] for r in found]
    assert sum(sizes) == 3750 and max(sizes) < 2 * sum(sizes) / 8


def test_latest_complete_state(spark, tmp_path):
    records = spark.createDataFrame([("A",)], "job_title string")
    urls = spark.createDataFrame([("https://h.com/1",)], "source_url string")
    assert sinks.load_state(spark, str(tmp_path), None, records.schema) is None
    for day, title in ((1, "A"), (2, "B")):
        sinks.save_state(urls, records.select(F.lit(title).alias("job_title")), str(tmp_path), datetime(2024, 6, day))
    # A later state whose run failed between its two tables.
    sinks.write_version(urls, f"{tmp_path}/urls", "20240603T000000")
    _, loaded = sinks.load_state(spark, str(tmp_path), None, records.schema)
    assert [r.job_title for r in loaded.collect()] == ["B"]
    assert sinks.load_state(spark, str(tmp_path), "20240603T000000", records.schema) is None


def test_posts_without_url_have_ids_of_their_own(spark, tmp_path):
    path = str(tmp_path / "posts")
    rows = spark.createDataFrame([("", "A", "m"), ("", "B", "m"), ("https://h.com/1", "C", "m")], "source_url string, job_title string, siteId string")
    for _ in range(2):  # a repeated load adds nothing
        posts_store.append_posts(rows, path, RUN)
    posts = posts_store.read_posts(spark, path)
    assert posts.count() == 3 and posts.select("id").distinct().count() == 3


def test_listing_with_frames_drops_its_own_address(spark):
    rows = [(1, 0, "https://x.com/careers", '<a href="/careers#jobs">self</a><a href="/jobs/1">j</a>'), (1, 1, "https://a.io/jobs/list", '<a href="/jobs/list">list</a><a href="/jobs/2">j</a>')]
    links = listing.new_links(spark.createDataFrame(rows, "page_id bigint, chunk_no int, url string, html string"), spark.createDataFrame([], "source_url string"))
    found = {r.url for r in links.collect()}
    assert "https://a.io/jobs/list" in found and "https://x.com/jobs/1" in found and not any(u.startswith("https://x.com/careers") for u in found)


def test_each_page_is_asked_once(spark, tmp_path):
    """A model that fails at random gives one row for each page, and is called once for each."""
    calls = str(tmp_path)

    def open_model():
        import os
        import uuid

        def answer(prompt):
            name = uuid.uuid4().hex
            open(os.path.join(calls, name), "w").close()
            if int(name, 16) % 2:
                raise RuntimeError("no answer")
            return '{"job_title": "Welder", "location": "Reno, NV"}'

        return answer

    details = spark.createDataFrame([(i, f"https://h.com/jobs/{i}", f"<p>page {i}</p>") for i in range(12)], "page_id bigint, url string, html string")
    categories = spark.createDataFrame([("1", "Trades", None), ("2", "Welder", "1")], "id string, name string, parent_id string")
    records = listing.detail_records(details, open_model, categories)
    assert sorted(r.page_id for r in records.collect()) == list(range(12)) and records.count() == 12
    assert all((r.category_name, r.state) == (("Welder", "Nevada") if r.parsed else ("", "")) for r in records.collect())
    import os

    assert len(os.listdir(calls)) == 12


def _counting_model(folder, fail=""):
    """A model that leaves a file for each prompt it is asked, and fails on some."""

    def open_model():
        import os
        import uuid

        def answer(prompts):
            for prompt in prompts:
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as note:
                    note.write(prompt)
            if fail and any(fail in prompt for prompt in prompts):
                raise RuntimeError("no answer")
            return [f"answer to {prompt}" for prompt in prompts]

        return answer

    return open_model


def test_answers_are_asked_once_and_kept(spark, tmp_path):
    from gleaner.sources.answers import with_answers

    calls, store = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    rows = spark.createDataFrame([(i, f"p{i % 5}" if i % 7 else None) for i in range(40)], "i int, prompt string")
    ask = lambda df, fail="": {r.i: r.response for r in with_answers(df, _counting_model(str(calls), fail), store, parallel=3, batched=True, slices=2).collect()}
    found = ask(rows)
    assert found == {i: f"answer to p{i % 5}" if i % 7 else None for i in range(40)}
    assert sorted(f.read_text() for f in calls.iterdir()) == [f"p{k}" for k in range(5)]
    assert ask(rows) == found and len(list(calls.iterdir())) == 5  # a second run asks nothing
    more = rows.unionByName(spark.createDataFrame([(100, "new"), (101, "bad")], "i int, prompt string"))
    first = ask(more, fail="bad")
    assert first[101] is None and len(list(calls.iterdir())) == 7
    # What failed is asked again, what was answered in the same run is not, unless they were one call.
    second = ask(more)
    assert second[101] == "answer to bad" and second[100] == "answer to new" and 8 <= len(list(calls.iterdir())) <= 9


def test_answers_survive_a_failed_run(spark, tmp_path, monkeypatch):
    from gleaner.sources.answers import with_answers
    from gleaner.sources.versions import VersionedTables

    calls, store = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(30)], "i int, prompt string")
    publish, done = VersionedTables.publish, []

    def fail_later(self, *args):
        if len(done) == 2:
            raise RuntimeError("lost")
        done.append(1)
        return publish(self, *args)

    with monkeypatch.context() as patched:
        patched.setattr(VersionedTables, "publish", fail_later)
        with pytest.raises(RuntimeError):
            with_answers(rows, _counting_model(str(calls)), store, batched=True, slices=4)
    asked = len(list(calls.iterdir()))
    assert with_answers(rows, _counting_model(str(calls)), store, batched=True, slices=4).filter("response is null").count() == 0
    assert len(list(calls.iterdir())) < asked + 30 and len({f.read_text() for f in calls.iterdir()}) == 30


def test_second_run_reads_only_short_listings(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def open_model():
        import os
        import uuid

        def answer(prompt):
            with open(os.path.join(str(calls), uuid.uuid4().hex), "w") as note:
                note.write(prompt)
            return '{"job_title": "Welder"}'

        return answer

    shallow = [(1, 10, "https://h.com/1/a"), (1, 11, "https://h.com/1/b"), (2, 20, "https://h.com/2/a")]
    deep = [*shallow, (1, 12, "https://h.com/1/c"), (2, 21, "https://h.com/2/b"), (3, 30, "https://h.com/3/a")]
    frames = [spark.createDataFrame([(*r, f"<p>{r[2]}</p>") for r in rows], "listing_id int, page_id int, url string, html string") for rows in (shallow, deep)]
    found = listing.two_phase_records(*frames, lambda rows: listing.detail_records(rows, open_model), 2, "page_id")
    assert sorted((r.listing_id, r.page_id) for r in found.collect()) == [(1, 10), (1, 11), (2, 20), (2, 21), (3, 30)]
    asked = sorted(re.search(r"Page: (\S+)", f.read_text()).group(1) for f in calls.iterdir())
    assert asked == sorted([*(r[2] for r in shallow), "https://h.com/2/a", "https://h.com/2/b", "https://h.com/3/a"])


def test_listing_records_hold_cleaned_html(spark):
    html = "<main><div id='cookieBar'>We use cookies</div><p>Weld \u00c2 here</p><p> </p></main>"
    rows = spark.createDataFrame([(1, "https://h.com/1", html), (2, "https://h.com/2", None)], "page_id int, url string, html string")
    found = {r.page_id: r for r in listing.detail_records(rows, stub_model()).collect()}
    assert found[1].html_content == "<main><p>Weld  here</p></main>"
    assert found[1].job_title == "Welder" and not found[2].html_content
    assert "html_content" not in listing.detail_records(rows, stub_model(), include_html=False).columns


def test_stream_adds_nothing_twice(spark, tmp_path):
    schema = "source_url string, job_title string, location string, feed_url string, pos int, site string"
    arrivals, posts = str(tmp_path / "in"), str(tmp_path / "posts")

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(arrivals)

    def run():
        stream = streaming.read_arrivals(spark, arrivals, schema, files_per_batch=1)
        streaming.incremental_ingest(stream, posts, str(tmp_path / "check"), RUN).awaitTermination()
        return sorted(r.source_url for r in posts_store.read_posts(spark, posts).select("source_url").collect())

    arrive([(f"https://h.com/{i}?x={i}", "T", "", "f", i, "m") for i in range(3)] + [("https://h.com/9", " ", "", "f", 9, "m")])
    first = run()
    assert first == [f"https://h.com/{i}?x={i}" for i in range(3)]
    assert run() == first
    arrive([("https://h.com/1", "T", "", "f", 1, "m"), ("https://h.com/4", "T", "", "f", 4, "m")])
    assert run() == sorted([*first, "https://h.com/4"])


@pytest.mark.parametrize("files", [1, 5])
def test_stream_keeps_what_the_cap_holds_back(spark, tmp_path, files):
    schema = "source_url string, job_title string, location string, feed_url string, pos int, site string"
    arrivals, posts = str(tmp_path / "in"), str(tmp_path / "posts")
    for k in range(files):
        rows = [(f"https://h.com/{i}", "T", "", "f", i, "m") for i in range(25) if i % files == k]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(arrivals)
    sizes = []
    for _ in range(4):
        stream = streaming.read_arrivals(spark, arrivals, schema, files_per_batch=1)
        streaming.incremental_ingest(stream, posts, str(tmp_path / "check"), RUN).awaitTermination()
        sizes.append(posts_store.read_posts(spark, posts).count())
    assert sizes == [10, 20, 25, 25]
    assert {r.source_url for r in posts_store.read_posts(spark, posts).collect()} == {f"https://h.com/{i}" for i in range(25)}


def test_stream_spills_to_the_next_feed(spark, tmp_path):
    schema = "source_url string, job_title string, location string, feed_url string, pos int, site string"
    arrivals, posts = str(tmp_path / "in"), str(tmp_path / "posts")
    rows = [(f"https://h.com/{i}", "T", "", "f1", i, "m") for i in range(12)] + [(f"https://h.com/{i}", "T", "", "f2", i, "m") for i in (10, 11)]
    rows += [("https://h.com/20?a", " ", "", "f0", 0, "m"), ("https://h.com/20?b", "T", "", "f0", 1, "m")]  # the untitled row hides nothing
    spark.createDataFrame(rows, schema).write.parquet(arrivals)
    streaming.incremental_ingest(streaming.read_arrivals(spark, arrivals, schema), posts, str(tmp_path / "check"), RUN).awaitTermination()
    assert sorted(r.source_url for r in posts_store.read_posts(spark, posts).collect()) == sorted([f"https://h.com/{i}" for i in range(12)] + ["https://h.com/20?b"])


def test_stream_first_per_key(spark, tmp_path):
    arrivals = str(tmp_path / "in")
    for i in range(2):
        spark.createDataFrame([(f"https://h.com/a?run={i}",), (f"https://h.com/{i}",)], "url string").write.mode("append").parquet(arrivals)
    stream = streaming.stream_first_per_key(streaming.read_arrivals(spark, arrivals, "url string", 1))
    query = stream.writeStream.format("memory").queryName("first_keys").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.url_key for r in spark.table("first_keys").collect()) == ["https://h.com/0", "https://h.com/1", "https://h.com/a"]


def test_company_profile(spark):
    home = '<h1>Firm</h1><div class="contact">Plant<br>Phone: 1</div>'
    rows = [
        (1, "https://h.com/", home, "https://h.com/about", "<main>About us</main>", " ", None, None, None),
        (2, "https://h.com/", home, "https://h.com/about", "<main>About us</main>", "https://h.com/c", "<p>none</p>", '{"description": null}', '{"regions":[]}'),
    ]
    schema = (
        "company_id int, home_url string, home_html string, about_url string, about_html string, contact_url string, contact_html string,"
        "about_response string, contact_response string"
    )
    found = {r.company_id: r for r in company_profile(spark.createDataFrame(rows, schema)).collect()}
    assert (found[1].home.company_name, found[1].about.description) == ("Firm", "About us")
    assert [(c.name, c.phone) for c in found[1].regions] == [("Plant", "1")]
    assert found[2].about.description is None and found[2].regions == []


def test_ensure_columns(spark):
    from gleaner.operators.shape import ensure_columns

    wanted = StructType.fromDDL("a string, b int")
    assert ensure_columns(spark.createDataFrame([("x",)], "a string"), wanted).first().asDict() == {"a": "x", "b": None}


def test_arrivals_of_a_batch_are_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "_folder", lambda _: f"{tmp_path}/run")
    spark.range(400).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 40).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority")
    ).write.parquet(f"{tmp_path}/orders.parquet")
    assert runs.q_stream_ingest(spark, str(tmp_path)).count() == 400
    assert len(list((tmp_path / "run/in").glob("part-*.parquet"))) > 3


def test_parts_of_events_are_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "_folder", lambda _: f"{tmp_path}/run")
    events = spark.range(1000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1.7e9) + F.col("id") * 60).alias("ts"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = [r.url_key for r in runs.q_stream_first(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(f"https://jobs.example.com/{i}" for i in range(1000))
    assert len(list((tmp_path / "run/in").glob("part-*.parquet"))) > 4


def test_page_identities_are_not_worked_out_in_filters(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(ingest_plan, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    configs = spark.createDataFrame([("1", "m1", '{"feeds":[{"url":"https://f.example.com/a"}]}')], "id string, micrositeId string, config string")
    sites = spark.createDataFrame([("m1", "o1")], "id string, userId string")
    listed = spark.range(20).repartition(4).select(F.lit("https://f.example.com/a").alias("feed_url"), F.format_string("https://j.example.com/%d?x=1", "id").alias("url"), F.col("id").alias("pos"))
    records = listed.select(F.col("url").alias("source_url"), F.lit("Cook").alias("job_title"), F.lit("").alias("location"))
    posts = spark.createDataFrame([("https://j.example.com/3?x=2",)], "source_url string")
    rows, _ = ingest_plan.scheduled_ingest(configs, sites, listed, records, posts, datetime(2024, 6, 1))
    assert rows.count() == 10
    assert not [line for line in plans[0].splitlines() if "Filter" in line and "opportunityId" in line and "j.example.com" in line]
