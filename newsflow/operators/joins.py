"""Joins: page enrichment, source lookup, new-versus-existing split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow import rules as R
from newsflow.operators.cleaning import ORD, keep_first

HOT_ROWS = 1_000_000
HOT_KEYS = 1_000  # at most so many keys are hot


def hot_key_left_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    ord_col: str = ORD,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join that spreads hot keys of the left side.

    ``right`` holds one row per key.  A key is hot from ``hot_rows`` left rows
    on, and from a ``HOT_KEYS``-th of all, so there are at most ``HOT_KEYS`` of
    them: a table of that size is broadcast and no row is moved to look it up.
    A hot key's rows are dealt to as many salts as make ``hot_rows`` each, and
    its right row is copied to them.  Left rows without key join nothing and are
    dealt at random.  The result is that of the plain left join.
    """
    keyed = left.where(F.col(key).isNotNull())
    total = keyed.agg(F.count(F.lit(1))).scalar()
    hot = F.broadcast(
        keyed.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= F.greatest(F.lit(hot_rows), total / HOT_KEYS))
        .select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    )
    dealt = F.xxhash64(ord_col)
    salt = F.when(F.col(key).isNull(), dealt).otherwise(
        F.pmod(dealt, F.coalesce("_salts", F.lit(1)))
    )
    salted_left = left.join(hot, key, "left").withColumn("_salt", salt).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_right = right.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.transform(copies, lambda i: i.cast("bigint")))
    ).drop("_salts")
    return salted_left.join(salted_right, [key, "_salt"], "left").drop("_salt")


def enrich_content(
    items: DataFrame,
    pages: DataFrame,
    mode: str = "feed",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Fill item bodies and images from their stored pages.

    ``pages`` has ``url``, ``page_text``, ``image_url`` and ``_ord``; the first
    page of a URL counts.  ``mode="feed"``: a body shorter than 500 characters
    is replaced by the page text, the item's own image wins.
    ``mode="story"``: only an empty body of an item that brought a URL
    (``_has_page``) is filled.  Items that need no page skip the join.
    """
    if mode not in ("feed", "story"):
        raise ValueError(f"unknown mode: {mode}")
    body = F.coalesce("content", F.lit(""))
    needs = F.length(body) < R.SHORT_CONTENT_CHARS if mode == "feed" else body == ""
    if "_has_page" in items.columns:
        needs = needs & F.col("_has_page")
    own_image = F.col("image_url") if "image_url" in items.columns else F.lit(None).cast("string")
    page = keep_first(pages.where(F.col("url").isNotNull()), F.col("url")).select(
        F.col("url").alias("_page_url"),
        F.col("page_text").alias("_page_text"),
        F.col("image_url").alias("_page_image"),
    )
    keyed = items.withColumn("_own_image", own_image).withColumn(
        "_page_url", F.when(needs, F.col("url"))
    )
    joined = hot_key_left_join(keyed, page, "_page_url", hot_rows=hot_rows)
    return joined.withColumns(
        {
            "content": F.coalesce(F.nullif("_page_text", F.lit("")), body),
            "image_url": F.coalesce("_own_image", "_page_image"),
        }
    ).drop("_page_url", "_page_text", "_page_image", "_own_image", "_has_page")


def resolve_source(articles: DataFrame, sources: DataFrame, name: str = "source_name") -> DataFrame:
    """``source_id`` of every article, null for unknown names.

    The dimension has one row per feed; Spark broadcasts it when its size is
    below the session's broadcast threshold and joins by shuffle otherwise.
    """
    ids = sources.groupBy(F.col("name").alias(name)).agg(F.min("id").alias("source_id"))
    return articles.drop("source_id").join(ids, name, "left")


def match_existing(batch: DataFrame, target: DataFrame) -> DataFrame:
    """``_target``: hash of the stored article a batch row updates -- by hash,
    else by URL, null for a new article.

    The target is first cut to the keys the batch asks for.  Against a batch
    below the broadcast threshold that is a scan of two narrow columns without
    a shuffle, however large the table.  Batch rows without a key to look up
    get one of their own, so they don't pile up in one task.
    """
    own: Column = F.concat(F.lit("\n"), F.col(ORD).cast("string"))
    wanted = batch.where(F.col("hash_id").isNotNull()).select("hash_id").distinct()
    by_hash = target.select("hash_id").join(wanted, "hash_id", "left_semi").select(
        F.col("hash_id").alias("_key"), F.col("hash_id").alias("_by_hash")
    )
    hashed = batch.withColumn("_key", F.coalesce("hash_id", own)).join(by_hash, "_key", "left")
    open_url = F.when(F.col("_by_hash").isNull(), F.col("url"))
    # an anti join is planned with the batch's size, an outer one with a product
    asked = batch.where(F.col("url").isNotNull()).select("hash_id", "url").join(
        by_hash.select(F.col("_by_hash").alias("hash_id")), "hash_id", "left_anti").select("url").distinct()
    # several stored rows with one url: the smallest hash stands for them
    by_url = (
        target.select("url", "hash_id")
        .join(asked, "url", "left_semi")
        .groupBy(F.col("url").alias("_url"))
        .agg(F.min("hash_id").alias("_by_url"))
    )
    return (
        hashed.withColumn("_url", F.coalesce(open_url, own))
        .join(by_url, "_url", "left")
        .withColumn("_target", F.coalesce("_by_hash", "_by_url"))
        .drop("_key", "_url", "_by_hash", "_by_url")
    )


def split_new_vs_existing(batch: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows, rows that update a stored article, with its ``_target``)."""
    matched = match_existing(batch.select(ORD, "hash_id", "url"), target)
    found = F.col("_target").isNotNull()
    new = batch.join(matched.where(~found).select(ORD), ORD, "left_semi")
    return new, batch.join(matched.where(found).select(ORD, "_target"), ORD)
