"""Article, metric and run views over the generic test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.urls import url_host
from newsflow.operators.cleaning import ORD
from newsflow.operators.pages import main_text, page_title
from newsflow.schemas import SCRAPE_LOG

CATEGORY_CASES = ("ai", "FUNDING", "retail", "ask hn", "e-commerce", "", "Web Development", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(df: DataFrame) -> DataFrame:
    """Dealt anew if the session's ``newsflow.view.partitions`` says so -- for
    one machine whose test file is a single row group; not set on a cluster."""
    parts = df.sparkSession.conf.get("newsflow.view.partitions", None)
    return df.repartition(int(parts)) if parts else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(table(spark, sf_dir, "pages")).withColumn(ORD, F.col("page_id"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(table(spark, sf_dir, "conversations"))


def _pick(values, index):
    chain = F
    for i, value in enumerate(values):
        chain = chain.when(index == i, F.lit(value))
    return chain.otherwise(F.lit(None).cast("string"))


def articles_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw articles: one per document, with the cases the cleaner must handle."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    published = (
        F.when(F.col("doc_id") % 5 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T06:30:00+05:30")))
        .when(F.col("doc_id") % 5 == 2, F.date_format(day, "MMMM d, yyyy"))
        .when(F.col("doc_id") % 5 == 3, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 12:15:00")))
        .otherwise(F.lit("junk"))
    )
    title = F.substring(F.regexp_extract("text", r"^([^.\n]*)", 1), 1, 120)
    escaped = F.replace("text", F.lit("&"), F.lit("&amp;"))
    content = F.when(
        F.col("doc_id") % 3 == 0,
        F.concat(
            F.lit("<p>"), F.replace(escaped, F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p>")
        ),
    ).otherwise(F.concat(escaped, F.lit("&nbsp; &lt;b&gt;caf&eacute;&lt;/b&gt; ")))
    return documents(spark, sf_dir).select(
        F.col("source"),
        title.alias("title"),
        F.concat(
            F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"),
            F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "/").otherwise(""),
        ).alias("url"),
        F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("author "), (F.col("doc_id") % 17).cast("string"))
        ).alias("author"),
        published.alias("published_at"),
        F.lit("2024-03-01T00:00:00.000000+00:00Z").alias("scraped_at"),
        content.alias("content"),
        F.substring("text", 1, 300).alias("summary"),
        _pick(CATEGORY_CASES, F.col("doc_id") % len(CATEGORY_CASES)).alias("category"),
        F.array("lang", F.upper("source"), F.lit("C++"), F.lit("News Desk"), "lang").alias("tags"),
        F.to_variant_object(
            F.struct((F.col("doc_id") % 97).alias("score"), (F.col("n_chars") % 13).alias("upvotes"))
        ).alias("metadata"),
        F.col("doc_id").alias(ORD),
    )


def articles_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw articles: one per stored page."""
    host = url_host(F.col("url"))
    return pages(spark, sf_dir).select(
        host.alias("source"),
        page_title(F.col("html")).alias("title"),
        "url",
        F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("string").alias("published_at"),
        F.lit("2024-03-01T00:00:00.000000+00:00Z").alias("scraped_at"),
        main_text(F.col("html")).alias("content"),
        F.lit("").alias("summary"),
        F.lit(None).cast("string").alias("category"),
        F.array().cast("array<string>").alias("tags"),
        ORD,
    )


def runs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log: errors are failed runs, purchases and signups finished ones,
    views are still running; clicks are no runs."""
    status = (
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type").isin("purchase", "signup"), "success")
        .when(F.col("event_type") == "view", "running")
    )
    started = F.col("ts").cast("timestamp")
    seconds = F.get_json_object("props", "$.k").cast("bigint")
    completed = F.when(
        F.col("event_type") != "view", F.timestamp_add("SECOND", seconds, started)
    )
    log = table(spark, sf_dir, "events").where(status.isNotNull()).select(
        F.concat(F.lit("source"), (F.col("user_id") % 5).cast("string")).alias("source_name"),
        started.alias("started_at"),
        completed.alias("completed_at"),
        F.when(completed.isNotNull(), seconds).alias("duration_seconds"),
        status.alias("status"),
        seconds.alias("articles_scraped"),
        F.when(status == "success", seconds).otherwise(0).alias("articles_added"),
        F.lit(0).cast("bigint").alias("articles_updated"),
        F.lit(0).cast("bigint").alias("articles_skipped"),
        F.when(status == "success", F.floor(seconds / 10)).otherwise(0).alias("articles_pruned"),
        F.lit(None).cast("string").alias("error_message"),
    )
    assert [f.split()[0] for f in SCRAPE_LOG.split(", ")] == log.columns
    return log
