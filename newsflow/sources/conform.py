"""One schema for all feeds, and the merge of several feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow import rules as R
from newsflow.functions.arrays import empty_strings
from newsflow.functions.dates import ingest_date_text
from newsflow.functions.text import default_if_blank
from newsflow.operators.cleaning import ORD, keep_first

FIELDS = ("title", "url", "author", "published_at", "content", "summary", "category", "tags")
_RANK_BITS = 48  # feed rank above, position in the feed below


def arrival(order: Column, position: Column, bits: int) -> Column:
    """Order of arrival of an item: its container's order, then its position.
    Out of range is an error, so no two items ever share a place."""
    fits = (position >= 0) & (position < (1 << bits)) & (F.abs(order) < (1 << (63 - bits)))
    return F.when(fits, order.cast("bigint") * F.lit(1 << bits) + position).otherwise(
        F.raise_error(F.lit("position in a container out of range")).cast("bigint")
    )


def conform_article(
    df: DataFrame, source: str | Column, scraped_at: Column | None = None
) -> DataFrame:
    """Raw articles in the common schema with the ingest defaults.

    Missing columns become typed nulls first, so no later step asks whether a
    column exists.  ``published_at`` texts pass the ingest date check; extra
    columns (``metadata``, ``metrics``, ``_ord``) are kept.
    """
    absent = {
        c: (empty_strings() if c == "tags" else F.lit(None).cast("string"))
        for c in FIELDS
        if c not in df.columns
    }
    df = df.withColumns(absent) if absent else df
    if scraped_at is None:
        scraped_at = (
            F.col("scraped_at") if "scraped_at" in df.columns
            else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00Z'")
        )
    label = F.lit(source) if isinstance(source, str) else source
    extra = [c for c in df.columns if c not in FIELDS + ("source", "scraped_at")]
    return df.select(
        label.alias("source"),
        default_if_blank(F.col("title"), R.INGEST_DEFAULTS["title"]).alias("title"),
        "url",
        default_if_blank(F.col("author"), R.INGEST_DEFAULTS["author"]).alias("author"),
        ingest_date_text(F.col("published_at")).alias("published_at"),
        scraped_at.alias("scraped_at"),
        default_if_blank(F.col("content"), R.INGEST_DEFAULTS["content"]).alias("content"),
        default_if_blank(F.col("summary"), R.INGEST_DEFAULTS["summary"]).alias("summary"),
        default_if_blank(F.col("category"), R.INGEST_DEFAULTS["category"]).alias("category"),
        F.coalesce("tags", empty_strings()).alias("tags"),
        *extra,
    )


def union_feeds(feeds: list[DataFrame], labels: list[str] | None = None) -> DataFrame:
    """Several feeds, days or time spans in order; the first feed that brings a
    URL (compared exactly) wins.  ``labels`` records the winning feed in
    ``timespan``."""
    ranked = []
    for rank, feed in enumerate(feeds):
        if labels:
            feed = feed.withColumn("timespan", F.lit(labels[rank]))
        ranked.append(feed.withColumn(ORD, arrival(F.lit(rank), F.col(ORD), _RANK_BITS)))
    merged = ranked[0]
    for feed in ranked[1:]:
        merged = merged.unionByName(feed, allowMissingColumns=True)
    return keep_first(merged, F.col("url"))
