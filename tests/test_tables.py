import datetime as dt
import os
import random

import pytest

from pyspark.sql import functions as F

from newsflow.operators import joins as J
from newsflow.operators.analytics import article_by_id
from newsflow.operators import tables as M
from newsflow.plans.batch import interleave_sources, run_all, run_one
from newsflow.schemas import STORY
from newsflow.session import scratch_dir
from newsflow.sources.registry import default_sources
from newsflow.sources.stories import parse_stories

from helpers import article, raw

NOW = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)
LATER = NOW + dt.timedelta(hours=1)


def batch(spark, *rows):
    """Records (hash, url, title, category) in order of arrival."""
    return spark.createDataFrame(
        [(*r, i) for i, r in enumerate(rows)],
        "hash_id string, url string, title string, category string, _ord bigint",
    )


def stored(spark, tmp_path, *rows):
    table = M.init_tables(spark, str(tmp_path / "table")).articles
    table.write(M.upsert_articles(table.read(), batch(spark, *rows), NOW))
    return table


def rows_of(df):
    return sorted((r.hash_id, r.url, r.title, r.category) for r in df.collect())


def test_insert_defaults(spark, tmp_path):
    row = stored(spark, tmp_path, ("h", "u", "t", None)).read().first()
    assert row.category is None and row.source_name == "unknown"
    assert (row.content, row.tags, row.has_content, row.ai_confidence) == ("", [], False, 0.0)
    assert row.generated_at == row.created_at == row.scraped_at is not None


def test_ids_stay_and_new_ones_follow(spark, tmp_path):
    table = stored(spark, tmp_path, ("h1", "u1", "one", "A"), ("h2", "u2", "two", "B"))
    before = {r.url: r.id for r in table.read().collect()}
    table.write(M.upsert_articles(
        table.read(), batch(spark, ("h1", "u1", "x", "A"), ("h3", "u3", "y", "B"), ("h4", "u4", "z", "B")), LATER))
    after = {r.url: r.id for r in table.read().collect()}
    assert min(before.values()) >= 1 and len(set(after.values())) == 4
    assert {u: after[u] for u in before} == before
    assert min(after["u3"], after["u4"]) > max(before.values())
    assert article_by_id(table.read(), after["u3"]).first().title == "y"


def test_match_by_hash_then_by_url(spark, tmp_path):
    table = stored(spark, tmp_path, ("h1", "u1", "one", "A"), ("h2", "u2", "two", "B"))
    second = batch(spark, ("h1", "u1", "ONE", "C"), ("hx", "u2", "TWO", None), ("h3", "u3", "three", "D"),
                   (None, "u1", "last", "E"))
    stats = M.upsert_stats(table.read(), second).first()
    assert (stats.added, stats.updated, stats.skipped, stats.errors) == (1, 2, 1, 0)
    out = M.upsert_articles(table.read(), second, LATER)
    assert sorted((r.url, r.title, r.category) for r in out.collect()) == [
        ("u1", "last", "E"), ("u2", "TWO", None), ("u3", "three", "D"),
    ]
    times = {r.url: (r.created_at, r.updated_at) for r in out.collect()}
    assert times["u1"][0] < times["u1"][1] and times["u3"][0] == times["u3"][1]


def test_twice_in_a_batch_the_last_wins(spark, tmp_path):
    empty = M.init_tables(spark, str(tmp_path / "t")).articles.read()
    both = batch(spark, ("h", "u", "first", "A"), ("h", "u", "second", "B"), (None, "v", "x", "C"),
                 (None, "v", "y", "D"), ("k", None, "no url", "E"), ("l", "w", None, "F"))
    assert sorted((r.url, r.title) for r in M.upsert_articles(empty, both, NOW).collect()) == [
        ("u", "second"), ("v", "y"),
    ]
    stats = M.upsert_stats(empty, both).first()
    assert (stats.added, stats.updated, stats.skipped, stats.errors) == (2, 0, 2, 2)


def test_second_run_adds_nothing(spark, tmp_path):
    rows = [(f"h{i}", f"u{i}", f"t{i}", "A") for i in range(20)]
    table = stored(spark, tmp_path, *rows)
    stats = M.upsert_stats(table.read(), batch(spark, *rows)).first()
    assert (stats.added, stats.updated) == (0, 20)
    again = M.upsert_articles(table.read(), batch(spark, *rows), LATER)
    assert rows_of(again) == rows_of(table.read())


def files_of(table):
    return {p: os.stat(p).st_mtime_ns for d, _, names in os.walk(table.path) for n in names
            if n.endswith(".parquet") for p in [os.path.join(d, n)]}


def test_folders_without_rows_go(spark, tmp_path):
    table = stored(spark, tmp_path, *[(f"h{i}", f"u{i}", "t", "A") for i in range(30)])
    table.delete(table.read().where("hash_id <> 'h7'").select("hash_id"))
    assert [r.hash_id for r in table.read().collect()] == ["h7"] and len(files_of(table)) == 1
    with pytest.raises(ValueError):
        table.write(table.read(), only={-1})
    with pytest.raises(ValueError):
        M.ParquetTable(spark, table.path, buckets=7919).create()
    table.write(table.read().limit(0))
    assert table.read().count() == 0 and not files_of(table)


def test_merge_needs_a_catalog_with_row_level_changes(spark, tmp_path):
    """The upsert is one MERGE: its plan matches by hash, updates and inserts;
    Parquet tables of the session catalog refuse it."""
    spark.sql("DROP TABLE IF EXISTS merged_articles")
    try:
        spark.createDataFrame([], "hash_id string, url string, title string, category string, updated_at timestamp").write.option(
            "path", str(tmp_path / "merged")).saveAsTable("merged_articles")
        table = M.CatalogTable(spark, "merged_articles").create()
        rows = M.prepare_batch(batch(spark, ("h", "u", "t", "A"), ("k", "v", "w", None)), table.read())
        merger = table.merger(rows, F.lit(NOW))
        with pytest.raises(Exception, match="MERGE INTO TABLE"):
            merger.merge()
        with pytest.raises(Exception, match="MERGE INTO TABLE"):
            table.delete(table.read().select("hash_id"))
    finally:
        spark.sql("DROP TABLE IF EXISTS merged_articles")


def test_partitioned_table(spark, tmp_path):
    rows = stored(spark, tmp_path, *[(f"h{i}", f"u{i}", "t", "AB"[i % 2]) for i in range(9)]).read()
    table = M.ParquetTable(spark, str(tmp_path / "by"), partition_by=("category",)).create()
    table.write(rows)
    assert table.read().columns == rows.columns and rows_of(table.read()) == rows_of(rows)
    plan = table.read().where("category = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan
    # a row that changes its category leaves no copy behind, whatever the name of the folder
    for name in ("a/b=c%", None, "A"):
        table.write(table.read().withColumn("category", F.when(F.col("hash_id") == "h3", F.lit(name)).otherwise("B")))
        assert rows_of(table.read())[3] == ("h3", "u3", "t", name) and table.read().count() == 9


def test_small_batch_does_not_shuffle_the_table(spark, tmp_path):
    table = stored(spark, tmp_path, *[(f"h{i}", f"u{i}", "t", "A") for i in range(50)])
    batch(spark, ("h1", "u1", "x", "B"), ("n", "u2", "y", "C")).write.parquet(str(tmp_path / "b"))
    small = spark.read.parquet(str(tmp_path / "b"))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    lookup = plan(M.prepare_batch(small, table.read()))
    assert "BroadcastHashJoin [hash_id" in lookup and "BroadcastHashJoin [url" in lookup
    merge = plan(M.upsert_articles(table.read(), small, LATER).drop("id"))
    assert "BroadcastHashJoin [hash_id" in merge
    # only new rows are shuffled, to be numbered
    stored_part = merge.split("Union")[1].split("isnull(_target")[0]
    assert "SortMergeJoin" not in stored_part and "hashpartitioning" not in stored_part


def test_init_twice(spark, tmp_path):
    first = files_of(M.init_tables(spark, str(tmp_path)).sources)
    again = M.init_tables(spark, str(tmp_path))
    assert first and files_of(again.sources) == first
    assert again.sources.read().count() == 5 and again.articles.read().count() == 0


def test_write_raw(spark, tmp_path):
    df = with_metadata(raw(spark, feed_rows(3, source="a") + feed_rows(2, start=5, source="b")))
    folder = M.write_raw(df, str(tmp_path), NOW)
    assert folder.endswith("/20240601_000000")
    back = spark.read.json(folder)
    assert back.groupBy("source").count().orderBy("source").collect() == [("a", 3), ("b", 2)]
    assert back.select("metadata.score").distinct().collect() == [(3,)]


def test_split_new_vs_existing(spark, tmp_path):
    table = stored(spark, tmp_path, ("h1", "u1", "one", "A"))
    new, known = J.split_new_vs_existing(
        batch(spark, ("h1", "x", "a", ""), ("z", "u1", "b", ""), (None, "u9", "c", ""), ("n", "u8", "d", "")),
        table.read(),
    )
    assert sorted(r._ord for r in new.collect()) == [2, 3]
    assert sorted((r._ord, r._target) for r in known.collect()) == [(0, "h1"), (1, "h1")]


def dated(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id bigint, generated_at timestamp")


def kept_by_brute_force(values, n):
    ranked = sorted(values, key=lambda v: (v is not None, -v.timestamp() if v else 0))
    if len(ranked) <= n or ranked[n - 1] is None:
        return list(range(len(values)))
    return [i for i, v in enumerate(values) if v is None or v >= ranked[n - 1]]


def test_prune(spark):
    minutes = [NOW - dt.timedelta(minutes=i) for i in range(150)]
    cases = {
        "distinct": (minutes, 100),
        "ties": ([NOW - dt.timedelta(minutes=i // 7) for i in range(150)], 100),
        "nulls": (minutes[:60] + [None] * 30, 50),
        "only nulls": ([None] * 20, 10),
        "more nulls than n": ([None] * 20 + minutes[:5], 10),
        "few": (minutes[:5], 10),
    }
    for name, (values, n) in cases.items():
        got = sorted(r.id for r in M.prune_newest(dated(spark, values), n).collect())
        assert got == kept_by_brute_force(values, n), name
    report = M.prune_report(dated(spark, minutes), 100).first()
    assert (report.total, report.kept, report.deleted) == (150, 100, 50)


def test_prune_by_histogram_equals_top_n(spark):
    random.seed(1)
    values = [
        None if random.random() < 0.05
        else NOW - dt.timedelta(microseconds=random.choice([1, 1000, 10**6, 10**9, 10**11]) * random.randint(0, 9))
        for _ in range(400)
    ]
    for n in (1, 5, 30, 200, 399, 400, 1000):
        got = sorted(r.id for r in M.prune_newest(dated(spark, values), n).collect())
        assert got == kept_by_brute_force(values, n), n


def test_run_log_entry_is_replaced(spark, tmp_path):
    path = str(tmp_path / "log")
    for added in (1, 2):
        entry = M.run_entry(spark, "s", NOW, NOW + dt.timedelta(seconds=90.7), added=added)
        M.log_run(path, entry, 7)
    rows = M.read_log(spark, path).collect()
    assert [(r.source_name, r.articles_added, r.duration_seconds) for r in rows] == [("s", 2, 90)]


def feed_rows(n, start=0, source="s"):
    return [
        article(source=source, title=f"Titles number {i} distinct{i}", url=f"https://e.com/{i}",
                content="x" * 200, category="ai")
        for i in range(start, start + n)
    ]


def with_metadata(df):
    return df.withColumn("metadata", F.parse_json(F.lit('{"score": 3}')))


def test_run_all_ingests_counts_prunes_and_logs(spark, tmp_path):
    table = M.init_tables(spark, str(tmp_path / "table")).articles
    log = str(tmp_path / "log")
    feeds = {"hackernews": with_metadata(raw(spark, feed_rows(12))),
             "techcrunch": with_metadata(raw(spark, feed_rows(6, start=9)))}
    options = dict(log_path=log, sources=default_sources(spark), max_articles=10)
    results = [run_one(feeds, "hackernews", table, now=NOW, run_id=1, **options),
               run_one(feeds, "techcrunch", table, now=LATER, run_id=2, **options)]
    assert [(r["scraped"], r["added"], r["updated"], r["pruned"]) for r in results] == [
        (12, 12, 0, 2),  # one generation time: the hash decides at the cutoff
        (6, results[1]["added"], 6 - results[1]["added"], results[1]["added"]),
    ]
    assert table.read().count() == 10
    assert table.read().where(F.col("generated_at") == F.lit(LATER)).count() == 6
    assert "error" in run_one(feeds, "nowhere", table)
    got = table.read()
    assert got.where("category = 'AI/ML' and has_content").count() == got.count()
    assert M.read_log(spark, log).agg(F.sum("articles_added")).first()[0] == 12 + results[1]["added"]
    failing = {"bad": raw(spark, feed_rows(1)).drop("url"), "good": feeds["techcrunch"]}
    outcome = run_all(failing, table, now=LATER)
    assert "error" in outcome[0] and outcome[1]["added"] + outcome[1]["updated"] == 6


def test_hot_key_join_equals_the_plain_join(spark):
    left = spark.range(9_000).select(
        F.col("id").alias("_ord"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None))
        .otherwise((F.col("id") % 50).cast("string")).alias("k"),
    )
    right = spark.range(40).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    right = right.unionByName(spark.createDataFrame([("hot", -1)], "k string, v bigint"))
    joined = J.hot_key_left_join(left, right, "k", hot_rows=500)
    plain = left.join(right, "k", "left")
    columns = ["_ord", "k", "v"]
    assert joined.select(columns).exceptAll(plain.select(columns)).count() == 0
    assert joined.count() == plain.count() == 9_000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "SortMergeJoin" in line]
    assert all("_salt" in line for line in joins)  # nothing is moved by the raw key


def test_enrich_content_rules(spark):
    items = spark.createDataFrame(
        [(0, "u", "short", None, True), (1, "u", "x" * 500, "own", True), (2, "none", "", None, True),
         (3, "empty", "keep", None, True), (4, "u", "", "own", False), (5, None, "a", None, True)],
        "_ord bigint, url string, content string, image_url string, _has_page boolean",
    )
    pages = spark.createDataFrame(
        [(0, "u", "page one", "img"), (1, "u", "page two", "img2"), (2, "empty", "", "img3")],
        "_ord bigint, url string, page_text string, image_url string",
    )
    feed = J.enrich_content(items, pages).orderBy("_ord").collect()
    assert [r.content[:8] for r in feed] == ["page one", "xxxxxxxx", "", "keep", "", "a"]
    assert [r.image_url for r in feed] == ["img", "own", None, "img3", "own", None]
    story = J.enrich_content(items, pages, mode="story").orderBy("_ord").collect()
    assert [r.content[:8] for r in story] == ["short", "xxxxxxxx", "", "keep", "", "a"]


def test_resolve_source(spark):
    df = spark.createDataFrame([("techcrunch",), ("other",), (None,)], "source_name string")
    got = {r.source_name: r.source_id for r in J.resolve_source(df, default_sources(spark)).collect()}
    assert got == {"techcrunch": 2, "other": None, None: None}


def test_interleave_sources(spark):
    df = spark.range(3_000).select(
        F.col("id").alias("_ord"), F.when(F.col("id") % 3 > 0, "big").otherwise(
            (F.col("id") % 11).cast("string")).alias("source"))
    got = interleave_sources(df, 10).collect()
    assert len(got) == 12 * 10 and [r.turn for r in got] == sorted(r.turn for r in got)
    assert got == interleave_sources(df.repartition(5), 10).collect()
    plan = interleave_sources(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # ranks are cut before the shuffle too


def test_retention_is_asked_for(spark, tmp_path):
    table = M.init_tables(spark, str(tmp_path / "table")).articles
    run_one({"a": with_metadata(raw(spark, feed_rows(120)))}, "a", table, now=NOW)
    assert table.read().count() == 120


def test_staged_copies_are_deleted(spark, tmp_path):
    before = set(os.listdir(folder)) if os.path.isdir(folder := f"{scratch_dir(spark)}/newsflow") else set()
    table = M.init_tables(spark, str(tmp_path / "table")).articles
    feeds = {"a": with_metadata(raw(spark, feed_rows(12))), "bad": raw(spark, feed_rows(1)).drop("url")}
    run_all(feeds, table, max_articles=5, now=NOW)
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before


def test_prune_with_tie_keeps_exactly_n(spark):
    rows = [(f"h{i}", NOW - dt.timedelta(minutes=i // 40)) for i in range(150)] + [("x", None)] * 3
    df = spark.createDataFrame(rows, "hash_id string, generated_at timestamp")
    for n in (1, 5, 43, 90, 149, 153, 400):
        kept = M.prune_newest(df, n, tie="hash_id").collect()
        assert len(kept) == (min(n, 153) if n > 3 else 153)  # as many undated rows: no cutoff
        dates = sorted((r.generated_at for r in kept if r.generated_at), reverse=True)
        assert [d.replace(tzinfo=None) for d in dates] == sorted(
            (r[1].replace(tzinfo=None) for r in rows if r[1]), reverse=True)[: len(dates)]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = stored(spark, tmp_path, *[(f"h{i}", f"u{i}", "t", "A") for i in range(200)])
    before = files_of(table)
    feed = {"s": with_metadata(raw(spark, feed_rows(1)))}
    run_one(feed, "s", table, now=LATER)
    after = files_of(table)
    folders = {os.path.basename(os.path.dirname(p)) for p in set(after) ^ set(before)}
    assert len(folders) == 1 and len(before) == M.BUCKETS and table.read().count() == 201
    assert all(after[p] == before[p] for p in set(after) & set(before))
    assert M.ParquetTable(spark, table.path).read().where("title like 'Titles%'").count() == 1


def test_ids_do_not_depend_on_partitions(spark, tmp_path):
    empty = M.init_tables(spark, str(tmp_path / "t")).articles.read()
    rows = batch(spark, *[(f"h{i}", f"u{i}", "t", "A") for i in range(50)])
    ids = [
        {r.hash_id: r.id for r in M.upsert_articles(empty, rows.repartition(n), NOW).collect()} for n in (1, 7)]
    assert ids[0] == ids[1] and sorted(ids[0].values()) == list(range(1, 51))


def test_one_url_with_two_hashes_is_one_article(spark, tmp_path):
    empty = M.init_tables(spark, str(tmp_path / "t")).articles.read()
    rows = batch(spark, ("h1", "u", "first", "A"), ("h2", "u", "second", "B"), ("h1", "v", "third", "C"))
    assert sorted((r.url, r.title) for r in M.upsert_articles(empty, rows, NOW).collect()) == [("u", "second"), ("v", "third")]


def test_item_crawled_twice_is_stored_once(spark, tmp_path):
    def story(i, score):
        return (i, "story", f"Titles number {i} distinct{i}", f"https://e.com/{i}", "b", 1, score, 0, "")

    items = spark.createDataFrame([story(1, 5), story(1, 9), story(2, 1), story(2, 1), (None, *story(3, 1)[1:])], STORY)
    raw_rows = parse_stories(items)
    assert raw_rows.count() == raw_rows.select("_ord").distinct().count() == 4
    table = M.init_tables(spark, str(tmp_path / "table")).articles
    results = [run_one({"s": raw_rows}, "s", table, now=t) for t in (NOW, LATER)]
    assert [(r["added"], r["updated"]) for r in results] == [(3, 0), (0, 3)]
    assert table.read().count() == table.read().select("hash_id").distinct().count() == 3
