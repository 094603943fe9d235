"""Analytical queries over the article table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow import rules as R
from newsflow.functions.arrays import empty_strings
from newsflow.functions.text import excerpt_words

SENTIMENTS = ("positive", "negative", "neutral")
SURE = 0.5
HOUSE_AUTHOR = "Newsflow Desk"
MAX_OFFSET = 10_000  # rows of a feed that can be paged by number


def _check(name: str, value: int, low: int, high: int | None = None) -> None:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} out of range: {value}")


def newest_first(column: str = "published_at", tie: str = "hash_id") -> list[Column]:
    """Newest first, undated articles before all others, the hash as tie-break."""
    return [F.desc_nulls_first(column), F.asc(tie)]


# ----------------------------------------------------------------- projections
def article_by_id(df: DataFrame, article_id: int) -> DataFrame:
    _check("id", article_id, 1)
    return df.where(F.col("id") == article_id)


def to_summary(df: DataFrame, *extra: str) -> DataFrame:
    """The list view of an article: no body, a short summary, the image of its
    metadata; ``extra`` columns are added at the end."""
    summary = F.coalesce(F.substring("summary", 1, R.SUMMARY_CHARS), F.lit(""))
    keep = [
        c
        for c in (
            "id", "hash_id", "source_name", "title", "url", "author", "published_at",
            "generated_at",
        )
        if c in df.columns
    ]
    after = [c for c in ("extra_data", "ai_category", "sentiment") if c in df.columns]
    if "image_url" in df.columns:
        after.append("image_url")
    elif "extra_data" in df.columns:  # where the table keeps it
        after.append(F.try_variant_get("extra_data", "$.image_url", "string").alias("image_url"))
    return df.select(
        *keep,
        summary.alias("summary"),
        "category",
        F.coalesce("tags", empty_strings()).alias("tags"),
        *after,
        *extra,
    )


# ---------------------------------------------------------------- aggregations
def stats_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_articles"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_articles"))


def stats_by_source(df: DataFrame) -> DataFrame:
    return count_by(df, "source_name")


def stats_by_category(df: DataFrame) -> DataFrame:
    """Articles per category; null is a category of its own."""
    return count_by(df, "category")


def last_scraped(log: DataFrame, articles: DataFrame) -> DataFrame:
    """End of the latest finished run, else the latest scrape date."""
    latest_run = log.agg(F.max("completed_at").alias("run"))
    newest = articles.agg(F.max("scraped_at")).scalar()
    return latest_run.select(F.coalesce("run", newest).alias("last_scraped"))


def is_scraping(log: DataFrame) -> DataFrame:
    return log.agg((F.count_if(F.col("status") == "running") > 0).alias("is_scraping"))


def sentiment_distribution(df: DataFrame) -> DataFrame:
    return count_by(df.where(F.col("sentiment").isNotNull()), "sentiment")


def total_analyzed(df: DataFrame) -> DataFrame:
    return df.agg(F.count("sentiment").alias("total_analyzed"))


def ai_categories(df: DataFrame) -> DataFrame:
    """Articles per category of the analysis, sure verdicts only."""
    sure = df.where(F.col("ai_category").isNotNull() & (F.col("ai_confidence") >= SURE))
    return count_by(sure, "ai_category")


def confidence_by_category(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("ai_confidence").isNotNull())
        .groupBy("category")
        .agg(F.coalesce(F.round(F.avg("ai_confidence"), 2), F.lit(0.0)).alias("avg_confidence"))
    )


def top_keywords(df: DataFrame, limit: int = 20) -> DataFrame:
    """Most frequent keywords over all articles."""
    return (
        df.where(F.col("ai_keywords").isNotNull())
        .select(F.explode("ai_keywords").alias("keyword"))
        .groupBy("keyword")
        .agg(F.count(F.lit(1)).alias("n_articles"))
        .orderBy(F.desc("n_articles"), "keyword")
        .limit(limit)
    )


def insights(df: DataFrame, keyword_limit: int = 20) -> DataFrame:
    """Mood, sure categories, confidence per category, keywords and the number
    analysed, as (metric, key, value) rows.

    The four small groupings share one scan: each article contributes one row
    per metric to a single aggregation, reduced before its shuffle.
    """
    def entry(metric: str, key: Column, value: Column, when: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(metric).alias("metric"), key.alias("key"), value.cast("double").alias("v")
            ),
        )

    one, sure = F.lit(1), F.col("ai_confidence")
    entries = F.array_compact(
        F.array(
            entry("sentiment", F.col("sentiment"), one, F.col("sentiment").isNotNull()),
            entry("ai_category", F.col("ai_category"), one,
                  F.col("ai_category").isNotNull() & (sure >= SURE)),
            entry("confidence", F.col("category"), sure, sure.isNotNull()),
            entry("total_analyzed", F.lit("all"), one, F.col("sentiment").isNotNull()),
        )
    )
    grouped = (
        df.select(F.inline(entries))
        .groupBy("metric", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
        .select(
            "metric", "key",
            F.when(F.col("metric") == "confidence", F.round("mean", 2))
            .otherwise(F.col("n").cast("double"))
            .alias("value"),
        )
    )
    words = top_keywords(df, keyword_limit).select(
        F.lit("keyword").alias("metric"),
        F.col("keyword").alias("key"),
        F.col("n_articles").cast("double").alias("value"),
    )
    return grouped.unionByName(words)


def dashboard_kpis(df: DataFrame) -> DataFrame:
    """Articles, sources, categories (a missing one counts) and generated ones.

    Distinct values are counted over the few (source, category) pairs.
    """
    pairs = df.groupBy("source_name", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count("generated_at").alias("generated")
    )
    unnamed = F.max(F.when(F.col("category").isNull(), 1).otherwise(0))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_articles"),
        F.count_distinct("source_name").alias("active_sources"),
        (F.count_distinct("category") + F.coalesce(unnamed, F.lit(0))).alias("categories"),
        F.coalesce(F.sum("generated"), F.lit(0)).alias("generated"),
    )


# ------------------------------------------------------------------ list views
def article_feed(
    df: DataFrame,
    source: str | None = None,
    category: str | None = None,
    page: int = 1,
    page_size: int = R.PAGE_SIZE,
    order_by: str = "published_at",
) -> DataFrame:
    """One page of the feed, newest first.

    Filters reach the scan; the page is one top-k over list-view rows.  Every
    row carries ``total`` (all articles, whatever the filter),
    ``filtered_total`` and ``has_more``, from one count over the filter columns.
    All rows before the page go through one task, so the first ``MAX_OFFSET``
    rows can be paged; ``article_feed_after`` goes on from there.
    """
    _check("page_size", page_size, 1, R.MAX_PAGE_SIZE)
    _check("page", page, 1, MAX_OFFSET // page_size)
    order = order_by if order_by in df.columns else "published_at"
    start = (page - 1) * page_size
    rows, chosen = df, F.lit(True)
    for column, value in (("source_name", source), ("category", category)):
        if value:
            rows = rows.where(F.col(column) == value)
            chosen = chosen & F.col(column).eqNullSafe(value)
    view = to_summary(rows)
    if order not in view.columns:
        view = to_summary(rows, order)
    filtered = df.agg(F.count_if(chosen)).scalar()
    return view.orderBy(*newest_first(order)).offset(start).limit(page_size).withColumns(
        {
            "total": df.agg(F.count(F.lit(1))).scalar(),
            "filtered_total": filtered,
            "has_more": filtered > start + page_size,
        }
    )


def article_feed_after(
    df: DataFrame,
    after: tuple[object, str] | None = None,
    page_size: int = R.PAGE_SIZE,
    order_by: str = "published_at",
) -> DataFrame:
    """The page that follows a row, newest first: ``after`` is the ``order_by``
    value and ``hash_id`` of the last row seen.  A page costs the same however
    deep it lies: one top-k of ``page_size`` rows behind a filter."""
    _check("page_size", page_size, 1, R.MAX_PAGE_SIZE)
    if after is not None:
        value, hash_id = after
        later = F.col("hash_id") > hash_id
        place = F.col(order_by)
        # nulls come first
        df = df.where(
            place.isNotNull() | later if value is None else (place < F.lit(value)) | ((place == F.lit(value)) & later)
        )
    view = to_summary(df)
    if order_by not in view.columns:
        view = to_summary(df, order_by)
    return view.orderBy(*newest_first(order_by)).limit(page_size)


def metric(name: str) -> Column:
    """An engagement counter of the open metadata, 0 if absent."""
    return F.coalesce(F.try_variant_get("extra_data", f"$.{name}", "bigint"), F.lit(0))


def trending_score() -> Column:
    return metric("score") + metric("upvotes") + metric("stars") + metric("today_stars") * 2


def trending(df: DataFrame, limit: int = R.PAGE_SIZE) -> DataFrame:
    """Highest engagement among the newest ``5 * limit`` articles, at most 100."""
    _check("limit", limit, 1, R.MAX_TRENDING)
    pool = (
        to_summary(df).orderBy(*newest_first()).limit(min(R.TRENDING_POOL, limit * 5))
    )
    scored = pool.withColumn("trend_score", trending_score())
    return scored.orderBy(F.desc("trend_score"), *newest_first()).limit(limit)


def articles_by_sentiment(df: DataFrame, sentiment: str, limit: int = R.PAGE_SIZE) -> DataFrame:
    """Articles of one mood: the clearest first for positive ones, the least
    clear first otherwise."""
    if sentiment not in SENTIMENTS:
        raise ValueError(f"sentiment must be one of {SENTIMENTS}: {sentiment}")
    _check("limit", limit, 1, R.MAX_PAGE_SIZE)
    # nulls stand where the largest value would
    order = (
        F.desc_nulls_first("sentiment_score")
        if sentiment == "positive"
        else F.asc_nulls_last("sentiment_score")
    )
    chosen = df.where(F.col("sentiment") == sentiment)
    view = to_summary(chosen, "sentiment_score")
    return view.orderBy(order, "hash_id").limit(limit)


def latest_ticker(df: DataFrame, n: int = 6) -> DataFrame:
    """The newest articles as ticker lines."""
    return (
        df.select("title", "source_name", "category", "published_at", "hash_id")
        .orderBy(*newest_first())
        .limit(n)
    )


def ticker(df: DataFrame, n: int = 6, hot: int = 5) -> DataFrame:
    """The newest articles and the ``hot`` ones with the highest engagement as
    ticker lines, told apart by ``kind``."""
    newest = latest_ticker(df, n)
    top = trending(df, hot).select(newest.columns)
    return newest.withColumn("kind", F.lit("latest")).unionByName(top.withColumn("kind", F.lit("trending")))


# ---------------------------------------------------------------- presentation
def present(df: DataFrame, words: int = 100) -> DataFrame:
    """Excerpt, byline, initials and the text to show."""
    author = F.col("author")
    byline = F.when(
        author.isNull() | author.isin("", "Unknown"), F.lit(HOUSE_AUTHOR)
    ).otherwise(author)
    return df.withColumns(
        {
            "excerpt": excerpt_words(F.col("summary"), words),
            "byline": byline,
            "initials": F.upper(F.substring(byline, 1, 2)),
            "body": F.coalesce(F.nullif("content", F.lit("")), F.col("summary"), F.lit("")),
        }
    )
