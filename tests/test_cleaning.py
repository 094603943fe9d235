import re

import pytest
from pyspark.sql import functions as F

from newsflow import views as V
from newsflow.operators import cleaning as C
from newsflow.plans.clean import clean_articles, clean_step_by_step
from checks.queries import _gappy

from helpers import article, column, raw


def test_empty_input_keeps_the_schema(spark):
    out = clean_articles(raw(spark, []))
    assert out.count() == 0 and "ai_category" in out.columns


def test_missing_url_and_title_drop(spark):
    rows = [
        article(url=None), article(title="", url="https://example.com/1"),
        article(title=" \t", url="https://example.com/2"),
        article(title="Valid", url="https://example.com/3"),
    ]
    assert [r.title for r in clean_articles(raw(spark, rows)).collect()] == ["Valid"]


def test_trailing_slash_is_the_same_url(spark):
    rows = [
        article(title="Article first", url="https://example.com/article"),
        article(title="Another copy", url="https://example.com/article/"),
    ]
    assert [r.title for r in clean_articles(raw(spark, rows)).collect()] == ["Article first"]


def test_null_urls_collapse_before_they_drop(spark):
    rows = [article(url=None, title=f"Title number {i}") for i in range(3)] + [article()]
    report = {r.operation: (r.before, r.after) for r in C.cleaning_report(raw(spark, rows)).collect()}
    assert report["remove_url_duplicates"] == (4, 2)
    assert report["handle_missing_values"] == (2, 1)


def test_overlapping_sample(spark):
    rows = [
        article(title="  Test Article One  ", url="https://example.com/article-1", category="ai",
                published_at="2025-01-15T10:30:00Z", content="This is the content of the article.",
                summary="", tags=["python", "AI", "python"]),
        article(title="Test Article One", url="https://example.com/article-1/", author="John Doe",
                published_at="January 15, 2025", category="machine learning"),
        article(title="Different Article", url="https://techcrunch.com/different", author="",
                content="Some content here that is long enough.", category="FUNDING", tags=["startup"]),
    ]
    got = clean_articles(raw(spark, rows)).orderBy("_ord").collect()
    assert [(r.title, r.category, r.author, r.tags) for r in got] == [
        ("Test Article One", "AI/ML", "Unknown", ["python", "ai"]),
        ("Different Article", "Funding", "Unknown", ["startup"]),
    ]
    assert [r.has_content for r in got] == [False, False]


@pytest.mark.parametrize(
    "given_category, expected",
    [
        ("artificial intelligence", "AI/ML"), ("FUNDING", "Funding"), ("retail", "AI/ML"),
        ("html", "AI/ML"), ("ask hn", "Ask Hn"), ("e-commerce", "E-Commerce"), (None, "Tech News"),
        ("", "Tech News"), ("  ", ""), ("Our Privacy Corner", "Security"), ("general", "Tech News"),
    ],
)
def test_standard_category(spark, given_category, expected):
    assert column(spark, [given_category], C.standard_category) == [expected]


def test_similar_titles(spark):
    titles = [
        "alpha bravo charlie delta echoes", "echoes delta charlie bravo alpha", "to be or not",
        "a b c", "alpha bravo charlie delta other",
    ]
    df = raw(spark, [article(title=t, url=f"https://e.com/{i}") for i, t in enumerate(titles)])
    assert sorted(r._ord for r in C.title_dedup(df).collect()) == [0, 2, 4]
    assert sorted(r._ord for r in C.title_dedup(df, keep_empty_key=True).collect()) == [0, 2, 3, 4]


def test_invalid_urls(spark):
    urls = ["ftp://x.com/a", "https:///nohost", "http://ok.com", "HTTPS://ok.com/b", "ok.com"]
    df = raw(spark, [article(url=u) for u in urls])
    assert sorted(r._ord for r in C.validate_urls(df).collect()) == [2, 3]


def test_unreadable_date_becomes_the_scrape_date(spark):
    df = raw(spark, [article(published_at="junk", scraped_at="2024-03-01T00:00:00.5+00:00Z")])
    row = C.standardize_dates(df).first()
    assert row.published_at == row.scraped_at and row.scraped_at is not None


def test_whole_job_equals_the_steps(spark, sf_dir):
    df = _gappy(spark, sf_dir)
    columns = ["_ord", "title", "url", "author", "published_at", "content", "summary", "category",
               "tags", "content_length", "has_content", "hash_id"]
    whole = clean_articles(df, ai=False).select(columns).collect()
    steps = clean_step_by_step(df).select(columns).collect()
    assert sorted(whole) == sorted(steps) and len(whole) > 50


def test_partitioning_does_not_matter(spark, sf_dir):
    df = V.articles_from_documents(spark, sf_dir)
    one = C.surviving_ords(df.repartition(1)).collect()
    many = C.surviving_ords(df.repartition(13)).collect()
    assert sorted(one) == sorted(many)


def test_cleaning_twice_drops_nothing_more(spark, sf_dir):
    once = clean_articles(_gappy(spark, sf_dir), ai=False)
    again = C.surviving_ords(once)
    assert again.count() == once.count()


def test_report_equals_the_counts_of_the_steps(spark, sf_dir):
    df = _gappy(spark, sf_dir)
    a = C.url_dedup(df)
    b = C.drop_missing_required(a)
    c = C.validate_urls(C.normalize_texts(C.fill_defaults(b)))
    d = C.title_dedup(c)
    counts = [x.count() for x in (df, a, b, c, d)]
    got = C.cleaning_report(df).orderBy("step").collect()
    assert [(r.before, r.after) for r in got] == list(zip(counts, counts[1:]))
    assert sum(r.removed for r in got) == counts[0] - counts[-1]


def test_report_of_nothing(spark):
    assert [(r.before, r.after) for r in C.cleaning_report(raw(spark, [])).collect()] == [(0, 0)] * 4


def test_hot_keys(spark):
    """A third of all rows without URL, a third with the same title key."""
    n = 30_000
    df = spark.range(n).select(
        F.lit("s").alias("source"),
        F.when(F.col("id") % 3 == 1, "the one same title")
        .otherwise(F.concat(F.lit("Title words"), F.col("id").cast("string"))).alias("title"),
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("http://h.com/"), F.col("id").cast("string"))).alias("url"),
        F.col("id").alias("_ord"),
    )
    got = sorted(r._ord for r in C.surviving_ords(df).collect())
    assert got == sorted([1] + list(range(2, n, 3)))


def test_bucketed_raw_table_is_not_shuffled(spark, sf_dir, tmp_path):
    """With raw articles bucketed by ``_ord`` only keys are exchanged."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sql("DROP TABLE IF EXISTS raw_bucketed")
    try:
        rows = _gappy(spark, sf_dir).drop("metadata")
        rows.write.bucketBy(8, "_ord").option("path", str(tmp_path / "raw")).saveAsTable("raw_bucketed")
        out = clean_articles(spark.table("raw_bucketed"), ai=False)
        plan = out._jdf.queryExecution().executedPlan()
        exchanges = [line for line in plan.toString().split("\n") if "Exchange" in line]
        # URL key, its first orders back to the flags, title key, surviving orders: one or two narrow columns each
        assert len(exchanges) == 4, exchanges
        assert sum("_url_key" in line for line in exchanges) == sum("_title_key" in line for line in exchanges) == 1
        assert sum("(_ord" in line for line in exchanges) == 2
        carried = re.findall(r"Project \[([^\]]*)\][^\n]*\n[^\n]*Exchange", plan.toString())
        assert not any(c in x for x in [*exchanges, *carried] for c in ("content", "summary", "tags", "author"))
        assert out.count() == clean_articles(rows, ai=False).count()
    finally:
        spark.sql("DROP TABLE IF EXISTS raw_bucketed")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_image_reaches_the_metadata(spark):
    rows = [(1, '{"a": 1}', "img"), (2, '{"image_url": "own"}', "img"), (3, '{"a": 2}', None), (4, None, "x")]
    df = spark.createDataFrame(rows, "_ord bigint, m string, image_url string").select(
        "_ord", F.parse_json("m").alias("metadata"), "image_url", F.lit("t").alias("title"))
    got = C.to_records(df).select("_ord", F.try_variant_get("extra_data", "$.image_url", "string").alias("i"),
                                F.try_variant_get("extra_data", "$.a", "int").alias("a")).orderBy("_ord").collect()
    assert [(r.i, r.a) for r in got] == [("img", 1), ("own", None), (None, 2), ("x", None)]
