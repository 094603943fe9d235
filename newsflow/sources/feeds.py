"""RSS items, general and categorised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow import rules as R
from newsflow.functions.dates import feed_date_text
from newsflow.functions.text import first_matching, joined_text, strip
from newsflow.operators.cleaning import ORD
from newsflow.schemas import RSS_ITEM
from newsflow.sources.conform import conform_article

ITEM = r"(?s)<item\b.*"  # of a text that ends before the item's closing tag


def _first_text(*columns):
    """First non-empty text."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns])


def _items(items: DataFrame) -> DataFrame:
    """The fields both feed kinds share; items without title or link drop."""
    body = F.coalesce(F.col("content:encoded"), F.col("content"))
    image = _first_text(F.col("`media:content`._url"), F.col("`media:thumbnail`._url"))
    tags = F.filter(
        F.transform(F.coalesce("category", F.array().cast("array<string>")), strip),
        lambda t: t != "",
    )
    return items.select(
        strip(F.col("title")).alias("title"),
        strip(F.col("link")).alias("url"),
        _first_text(F.col("dc:creator"), F.col("creator")).alias("author"),
        _first_text(F.col("author._VALUE"), F.col("author.name")).alias("_author_tag"),
        feed_date_text(F.col("pubDate")).alias("published_at"),
        joined_text(body).alias("content"),
        F.substring(joined_text(F.col("description")), 1, R.FEED_SUMMARY_CHARS).alias("summary"),
        tags.alias("tags"),
        image.alias("image_url"),
        ORD,
    ).where((F.col("title") != "") & (F.col("url") != ""))


def rss_articles(items: DataFrame, source: str = "techcrunch") -> DataFrame:
    """Items of a general feed: the first tag is the category."""
    first_tag = F.get("tags", F.lit(0))
    articles = _items(items).select(
        "*",
        F.coalesce(first_tag, F.lit(R.DEFAULT_CATEGORY)).alias("category"),
        F.to_variant_object(
            F.struct(F.lit("rss").alias("source_type"), F.col("image_url"))
        ).alias("metadata"),
    )
    return conform_article(articles.drop("_author_tag"), source)


def rss_articles_categorised(
    items: DataFrame, feed_category: str = "All", source: str = "venturebeat"
) -> DataFrame:
    """Items of a categorised feed: title words decide the category, else the
    feed's own; tags are distinct."""
    category = first_matching(
        F.lower("title"), R.FEED_TITLE_RULES, F.lit(feed_category)
    )
    articles = _items(items).select(
        "title", "url",
        F.coalesce("author", "_author_tag").alias("author"),
        "published_at", "content", "summary",
        F.array_distinct("tags").alias("tags"),
        "image_url", ORD,
        category.alias("category"),
        F.to_variant_object(
            F.struct(
                F.lit("rss").alias("source_type"),
                F.lit(feed_category).alias("feed_category"),
                F.col("image_url"),
            )
        ).alias("metadata"),
    )
    return conform_article(articles, source)


def items_from_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Parse item texts (one ``<item>`` each) with the fixed item schema."""
    return payloads.select(ORD, F.from_xml(column, RSS_ITEM).alias("item")).select(
        ORD, "item.*"
    )


def read_rss_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of stored feed files, any number of feed responses in any number of
    files.

    Files are cut at the items' closing tags, which Spark can do from the middle
    of a file, so a large one is read by several tasks.  The order of arrival is
    the file's path, then the place in it: of each split only its first row's
    number and its size are needed to number all items, so ``_ord`` is the same
    under any partitioning and no item is shuffled: one row per split is always
    broadcast, whatever size Spark expects of it.  Numbers have gaps.
    """
    lines = spark.read.option("lineSep", "</item>").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"), "value")
    splits = lines.groupBy("_file", "_start").agg(F.min("_row").alias("_first"), F.max("_row").alias("_last"))
    size = F.col("_last") - F.col("_first") + 1
    before = F.sum(size).over(Window.orderBy("_file", "_start")) - size  # one row per split
    places = splits.select("_file", "_start", (before - F.col("_first")).alias("_shift"))
    items = lines.withColumn("payload", F.regexp_extract("value", ITEM, 0)).where(F.col("payload") != "")
    placed = items.join(F.broadcast(places), ["_file", "_start"]).select(
        (F.col("_row") + F.col("_shift")).alias(ORD), F.concat("payload", F.lit("</item>")).alias("payload"))
    return items_from_payloads(placed)


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    return rss_articles(read_rss_items(spark, path))


def read_rss_categorised(spark: SparkSession, path: str, feed_category: str) -> DataFrame:
    return rss_articles_categorised(read_rss_items(spark, path), feed_category)
