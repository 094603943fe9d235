import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from newsflow.operators import tables as M
from newsflow.plans.batch import run_batch
from newsflow.schemas import STORY
from newsflow.sources.stories import parse_stories, read_stories
from newsflow.streaming.ingest import ingest_batch, read_quarantine, stream_dedup, stream_ingest, stream_unique
from newsflow.streaming.monitor import RunLog, run_status, source_health, stream_progress


def write_stories(folder, first, n):
    folder.mkdir(exist_ok=True)
    rows = [
        {"id": i, "type": "story" if i % 5 else "comment", "title": f"Stories about thing{i} number{i}",
         "url": f"https://example.com/{i}", "time": 1705312200 + i, "score": i}
        for i in range(first, first + n)
    ]
    (folder / f"part-{first}.json").write_text("\n".join(map(json.dumps, rows)))


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source = tmp_path / "in"
    for k in range(3):
        write_stories(source, 10 * k, 10)
    table = M.init_tables(spark, str(tmp_path / "table")).articles
    where = dict(checkpoint=str(tmp_path / "check"), log_path=str(tmp_path / "log"), max_files=1)

    def ingest():
        query = stream_ingest(spark, str(source), table, max_articles=None, **where)
        query.awaitTermination()

    ingest()
    log = M.read_log(spark, where["log_path"])
    assert log.count() == 3 and log.agg(F.sum("articles_added")).first()[0] == 24
    write_stories(source, 30, 10)
    ingest()
    whole = M.init_tables(spark, str(tmp_path / "whole")).articles
    run_batch("hackernews", read_stories(spark, str(source)), whole, max_articles=None)
    columns = ["hash_id", "url", "title", "category", "ai_category", "sentiment"]
    assert sorted(table.read().select(columns).collect()) == sorted(whole.read().select(columns).collect())
    row = table.read().first()
    assert row.scraped_at == row.generated_at


def test_repeated_batch_changes_nothing(spark, tmp_path):
    source = tmp_path / "in"
    write_stories(source, 0, 10)
    table = M.init_tables(spark, str(tmp_path / "table")).articles
    stories = read_stories(spark, str(source))
    results = [
        ingest_batch(stories, 0, "hackernews", table, lambda df: df, str(tmp_path / "log")) for _ in range(2)
    ]
    assert [(r["added"], r["updated"]) for r in results] == [(8, 0), (0, 8)]
    assert M.read_log(spark, str(tmp_path / "log")).count() == 1 and table.read().count() == 8


def test_failed_batch_is_logged(spark, tmp_path):
    table = M.init_tables(spark, str(tmp_path / "table")).articles
    broken = spark.range(3)
    args = (broken, 4, "s", table, lambda df: df, str(tmp_path / "log"))
    assert "error" in ingest_batch(*args, skip_failed=True)
    with pytest.raises(Exception):
        ingest_batch(*args)
    assert [r.status for r in M.read_log(spark, str(tmp_path / "log")).collect()] == ["failed"]


def test_stream_dedup_within_the_delay(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(f"https://e.com/{i % 4}", start + dt.timedelta(minutes=i)) for i in range(40)]
    seen = spark.createDataFrame(rows, "url string, ts timestamp")
    seen.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(seen.schema).parquet(str(tmp_path / "in"))
    query = (
        stream_dedup(stream, "ts", "2 hours").writeStream.format("memory").queryName("distinct_urls")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.table("distinct_urls").count() == 4
    progress = stream_progress(query)
    assert not progress["is_running"] and progress["batch_id"] >= 0


def test_state_is_exact_across_ticks_and_goes(spark, tmp_path):
    """Repeats in and across ticks, out-of-order and late rows, rows without URL; states expire."""
    hour, start = dt.timedelta(hours=1), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

    def at(h):
        return start + h * hour

    ticks = [
        [("a", 0), ("a", 1), ("b", 2), (None, 2), (None, 2)],
        [("a", 5), ("b", 1.5), ("c", 6), ("a", 11)],
        [("c", 5), ("a", 12), ("d", 30)],
        [("a", 31), ("c", 32), ("late", 3)],
        [("e", 90)],
        [("f", 91), ("late", 4)],
    ]
    kinds = "url string, at timestamp, place int, more variant"
    for i, rows in enumerate(ticks):
        df = spark.createDataFrame([(u, at(h), j) for j, (u, h) in enumerate(rows)], "url string, at timestamp, place int")
        df.withColumn("more", F.parse_json(F.lit('{"k": [1]}'))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, states = [], []
    query = stream_unique(stream, "at", "10 hours", "4 hours").writeStream.foreachBatch(
        lambda b, i: got.extend((r.url, r.at.replace(tzinfo=dt.timezone.utc), r.k) for r in b.select(
            "url", "at", F.variant_get("more", "$.k[0]", "int").alias("k")).collect())
    ).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    expected = [("a", 0), ("a", 11), ("a", 31), ("b", 2), ("c", 6), ("c", 32), ("d", 30), ("e", 90), ("f", 91), (None, 2)]
    assert sorted(map(str, got)) == sorted(str((u, at(h), 1)) for u, h in expected) or sorted(
        map(str, got)) == sorted(str((u, at(h), 1)) for u, h in [*expected, (None, 2)])
    assert max(states) > states[-1]


def test_state_calls_grow_with_buckets_not_articles(spark, tmp_path):
    """Many articles in few buckets: exact, and the store holds a state and a timer for each bucket; rows
    without URL or time pass."""
    hour, start = dt.timedelta(hours=1), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    expected, last, n = set(), {}, 0
    for tick in range(4):
        rows = []
        for i in range(900):
            article, at = (i * 7 + tick) % 300, tick * 6 + i * 37 % 900 / 150  # up to three times in a tick
            rows.append((n, f"https://e.com/{article}", start + at * hour))
            n += 1
        rows += [(n, None, start + tick * 6 * hour), (n + 1, "https://e.com/0", None)]
        expected |= {n, n + 1}
        n += 2
        for number, url, at in sorted((r for r in rows if r[1] and r[2]), key=lambda r: r[2]):
            if url not in last or at >= last[url] + 5 * hour:
                last[url] = at
                expected.add(number)
        df = spark.createDataFrame(rows, "number int, url string, at timestamp")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("number int, url string, at timestamp").option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in"))
    got = []
    query = stream_unique(stream, "at", "5 hours", "12 hours", buckets=4).writeStream.foreachBatch(
        lambda b, i: got.extend(r.number for r in b.select("number").collect())
    ).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(got) == len(set(got)) and set(got) == expected
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) <= 8


def test_every_tick_has_equally_many_files(spark, tmp_path):
    """Ticks with many rows, one row and none, written by all tasks."""
    from checks.queries import _tick_files

    rows = spark.range(1000).select("id", F.when(F.col("id") == 0, 3).otherwise(F.lit(5)).alias("tick"))
    files = _tick_files(spark, rows, str(tmp_path))
    assert files == spark.sparkContext.defaultParallelism
    written = sorted((p for p in (tmp_path / "in").glob("*.parquet")), key=lambda p: p.stat().st_mtime_ns)
    assert len(written) == 10 * files
    for tick in range(10):
        part = spark.read.schema("id long").parquet(*[str(p) for p in written[tick * files : (tick + 1) * files]])
        assert part.count() == {3: 1, 5: 999}.get(tick, 0)


def test_one_bad_item_stops_nothing(spark, tmp_path):
    source = tmp_path / "in"
    write_stories(source, 0, 12)
    (source / "bad.json").write_text('{"id": 50, "type": "story", "title":\n[1]\nnot json')
    table = M.init_tables(spark, str(tmp_path / "table")).articles

    def parse(items):
        return parse_stories(items.withColumn(
            "title", F.when(F.col("id").isin(3, 8), F.raise_error(F.lit("broken item"))).otherwise(F.col("title"))))

    query = stream_ingest(
        spark, str(source), table, str(tmp_path / "check"), str(tmp_path / "log"), parse=parse, quarantine=str(tmp_path / "bad"))
    query.awaitTermination()
    kept = sorted(int(r.url.rsplit("/")[-1]) for r in table.read().collect())
    assert kept == [i for i in range(12) if i % 5 and i not in (3, 8)]
    bad = read_quarantine(spark, str(tmp_path / "bad")).collect()
    unread = sorted(r.payload for r in bad if r.reason == "not an item")
    assert unread == sorted(['{"id": 50, "type": "story", "title":', "[1]", "not json"])
    failing = [json.loads(r.payload)["id"] for r in bad if r.reason != "not an item"]
    assert sorted(failing) == [3, 8] and all("broken item" in r.reason for r in bad if r.reason != "not an item")


def test_a_batch_that_fails_as_a_whole_still_stops(spark, tmp_path, monkeypatch):
    from newsflow.streaming import ingest

    monkeypatch.setattr(ingest, "FAILURES", 2)
    source = tmp_path / "in"
    write_stories(source, 0, 12)
    table = M.init_tables(spark, str(tmp_path / "table")).articles
    rows = spark.read.schema(STORY).json(str(source))
    with pytest.raises(Exception, match="always"):
        ingest.ingest_items(
            rows, 0, "hackernews", table, lambda d: d.withColumn("_ord", F.raise_error(F.lit("always")).cast("bigint")),
            str(tmp_path / "log"), str(tmp_path / "bad"))


def test_run_log_of_a_failing_stream(spark, tmp_path):
    source = tmp_path / "in"
    write_stories(source, 0, 10)
    log = RunLog(spark, str(tmp_path / "log"), "feed")
    spark.streams.addListener(log)

    def each(batch, batch_id):
        live = source_health(M.read_log(spark, log.log_path)).first()
        assert live.running == 1 and "Pipeline is not running" not in live.issues
        raise ValueError("no good batch")

    try:
        query = spark.readStream.schema(STORY).json(str(source)).writeStream.foreachBatch(each).option(
            "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        with pytest.raises(Exception):
            query.awaitTermination()
        assert log.ended.wait(60)
    finally:
        spark.streams.removeListener(log)
    runs = M.read_log(spark, log.log_path)
    status = run_status(runs).first()
    assert (status.scrapes_completed, status.scrapes_failed, status.running) == (0, 1, 0)
    assert "no good batch" in runs.first().error_message
