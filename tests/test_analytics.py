import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsflow.operators import analytics as A
from newsflow.streaming.monitor import run_status, source_health
from newsflow.operators.tables import run_entry

NOW = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)
SCHEMA = (
    "id bigint, hash_id string, source_name string, title string, url string, author string, "
    "published_at timestamp, summary string, content string, category string, tags array<string>, "
    "ai_category string, ai_confidence double, ai_keywords array<string>, sentiment string, "
    "sentiment_score double, scraped_at timestamp, generated_at timestamp, _ord bigint"
)


@pytest.fixture(scope="module")
def articles(spark):
    rows = [
        (i, f"h{i:02d}", "ab"[i % 2], f"t{i}", f"u{i}", "Unknown" if i % 2 else "ann",
         None if i == 7 else NOW - dt.timedelta(hours=i), "s" * 300, "", [None, "X", "Y"][i % 3], None,
         "P" if i % 4 else None, i / 30 + 0.2, ["k1", f"k{i % 5}"], ["positive", "negative", None][i % 3],
         i / 100, NOW, NOW if i else None, i)
        for i in range(30)
    ]
    scores = F.when(F.col("id") % 10 == 0, F.lit('{"score": 5, "stars": 2, "today_stars": 4}')).otherwise(
        F.when(F.col("id") == 29, '{"upvotes": 999}').otherwise("{}"))
    return spark.createDataFrame(rows, SCHEMA).withColumn("extra_data", F.parse_json(scores)).cache()


def ids(df):
    return [r.id for r in df.collect()]


def test_feed_pages(articles):
    first = A.article_feed(articles, page_size=4)
    rows = first.collect()
    assert [r.id for r in rows] == [7, 0, 1, 2]  # undated first
    assert {(r.total, r.filtered_total, r.has_more) for r in rows} == {(30, 30, True)}
    assert len(rows[0].summary) == 200 and rows[0].tags == [] and "content" not in first.columns
    last = A.article_feed(articles, page=8, page_size=4).collect()
    assert [r.id for r in last] == [28, 29] and not last[0].has_more
    assert ids(A.article_feed(articles, page=9, page_size=4)) == []


def test_feed_filters_and_orders(articles):
    got = A.article_feed(articles, source="b", category="X", page_size=3).collect()
    assert [r.id for r in got] == [7, 1, 13]
    assert {(r.total, r.filtered_total, r.has_more) for r in got} == {(30, 5, True)}
    assert ids(A.article_feed(articles, order_by="ai_confidence", page_size=2)) == [29, 28]
    assert ids(A.article_feed(articles, order_by="nothing", page_size=2)) == [7, 0]
    with pytest.raises(ValueError):
        A.article_feed(articles, page_size=101)
    with pytest.raises(ValueError):
        A.article_feed(articles, page=0)


def test_trending(articles):
    # pool of five: 7, 0, 1, 2, 3; only 0 has a score
    assert [(r.id, r.trend_score) for r in A.trending(articles, 1).collect()] == [(0, 15)]
    assert ids(A.trending(articles, 3)) == [0, 10, 7]
    assert ids(A.trending(articles, 50))[0] == 29
    with pytest.raises(ValueError):
        A.trending(articles, 51)


def test_by_sentiment(articles):
    assert ids(A.articles_by_sentiment(articles, "positive", 3)) == [27, 24, 21]
    assert ids(A.articles_by_sentiment(articles, "negative", 3)) == [1, 4, 7]
    with pytest.raises(ValueError):
        A.articles_by_sentiment(articles, "angry")


def test_lookup_and_ticker(articles):
    assert ids(A.article_by_id(articles, 3)) == [3] and ids(A.article_by_id(articles, 99)) == []
    with pytest.raises(ValueError):
        A.article_by_id(articles, 0)
    assert [r.title for r in A.latest_ticker(articles).collect()] == ["t7", "t0", "t1", "t2", "t3", "t4"]


def test_counts(articles):
    assert A.stats_total(articles).first()[0] == 30
    assert {(r[0], r[1]) for r in A.stats_by_source(articles).collect()} == {("a", 15), ("b", 15)}
    assert {(r[0], r[1]) for r in A.stats_by_category(articles).collect()} == {(None, 10), ("X", 10), ("Y", 10)}
    assert A.total_analyzed(articles).first()[0] == 20
    assert {(r[0], r[1]) for r in A.sentiment_distribution(articles).collect()} == {
        ("positive", 10), ("negative", 10)}
    sure = [i for i in range(30) if i % 4 and i / 30 + 0.2 >= 0.5]
    assert [(r[0], r[1]) for r in A.ai_categories(articles).collect()] == [("P", len(sure))]
    kpis = A.dashboard_kpis(articles).first()
    assert tuple(kpis) == (30, 2, 3, 29)


def test_keywords(articles):
    got = [(r.keyword, r.n_articles) for r in A.top_keywords(articles, 2).collect()]
    assert got == [("k1", 36), ("k0", 6)]


def test_insights_hold_the_single_queries(articles):
    got = {(r.metric, r.key): r.value for r in A.insights(articles, 3).collect()}
    for metric, df in (
        ("sentiment", A.sentiment_distribution(articles)), ("ai_category", A.ai_categories(articles)),
        ("confidence", A.confidence_by_category(articles)), ("keyword", A.top_keywords(articles, 3)),
    ):
        for key, value in df.collect():
            assert got.pop((metric, key)) == value
    assert got == {("total_analyzed", "all"): 20.0}


def test_present(articles):
    got = A.present(articles, 1).orderBy("id").limit(2).collect()
    assert [(r.byline, r.initials, len(r.body)) for r in got] == [("ann", "AN", 300), ("Newsflow Desk", "NE", 300)]


def log_of(spark, *runs):
    rows = None
    for source, status, minutes, added in runs:
        end = None if status == "running" else NOW + dt.timedelta(minutes=minutes)
        entry = run_entry(spark, source, NOW, end, status, added=added)
        rows = entry if rows is None else rows.unionByName(entry)
    return rows


def test_run_state(spark, articles):
    log = log_of(spark, ("a", "success", 1, 5), ("b", "success", 9, 1), ("a", "failed", 12, 0), ("c", "running", 0, 0))
    status = run_status(log).first()
    assert (status.articles_generated, status.scrapes_completed, status.scrapes_failed, status.running) == (6, 2, 1, 1)
    assert status.last_source_scraped == "b" and status.last_tick_at > status.last_scrape_at
    assert A.is_scraping(log).first()[0] is True
    assert A.last_scraped(log, articles).first()[0] == status.last_tick_at
    idle = log.where("status = 'running'")
    assert A.last_scraped(idle, articles).first()[0] == articles.agg(F.max("scraped_at")).first()[0]


def test_health(spark):
    log = log_of(
        spark, ("ok", "success", 1, 1), ("ok", "running", 0, 0), ("dry", "success", 1, 1), ("dry", "running", 0, 0),
        ("bad", "success", 1, 1), ("bad", "failed", 1, 0), ("bad", "failed", 2, 0), ("off", "failed", 1, 0),
    )
    waiting = spark.createDataFrame([("ok",), ("bad",)], "source_name string")
    got = {r.source_name: (r.status, len(r.issues)) for r in source_health(log, waiting).collect()}
    assert got == {"ok": ("healthy", 0), "dry": ("degraded", 1), "bad": ("degraded", 2), "off": ("stopped", 1)}


def test_feed_by_cursor_equals_pages(spark):
    rows = [(i, f"h{i:03}", dt.datetime(2024, 1, 1 + i // 9) if i % 11 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, hash_id string, published_at timestamp").selectExpr(
        "*", "'s' AS source_name", "'t' AS title", "'u' AS url", "'a' AS author", "'x' AS summary", "'c' AS category",
        "array('g') AS tags")
    whole = [r.id for r in A.article_feed(df, page_size=60).collect()]
    seen, after = [], None
    while page := A.article_feed_after(df, after, 7).collect():
        seen += [r.id for r in page]
        after = (page[-1].published_at, page[-1].hash_id)
    assert seen == whole
    with pytest.raises(ValueError):
        A.article_feed(df, page=1_000_000)
