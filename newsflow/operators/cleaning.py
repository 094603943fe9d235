"""Cleaning operators: deduplication, missing values, normal forms, report.

Keep-first rules need a total order of arrival: every frame carries a unique
``_ord``.  Duplicate groups are reduced with ``min`` before anything is
shuffled, so a key shared by a third of all rows costs one row per task, and
article bodies never travel with the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow import rules as R
from newsflow.functions.arrays import bind, empty_strings, string_map
from newsflow.functions.dates import article_date, article_date_text, stored_timestamp
from newsflow.functions.text import (
    clean_tag_list,
    default_if_empty,
    first_matching,
    is_blank,
    normalize_text,
    strip,
    title_case,
    title_key,
)
from newsflow.functions.urls import hash_id, is_http_url, url_key

ORD = "_ord"
TEXT_COLUMNS = ("title", "content", "summary", "author")
# the logged steps, in the order they run
STEPS = (
    "remove_url_duplicates",
    "handle_missing_values",
    "validate_urls",
    "remove_similar_titles",
)


def keep_first(df: DataFrame, key: Column, ord_col: str = ORD) -> DataFrame:
    """Keep the first row, by ``ord_col``, of every key."""
    first = (
        df.select(key.alias("_key"), F.col(ord_col))
        .groupBy("_key")
        .agg(F.min(ord_col).alias(ord_col))
        .select(ord_col)
    )
    return df.join(first, ord_col, "left_semi")


def url_dedup(df: DataFrame, url: str = "url", ord_col: str = ORD) -> DataFrame:
    """Keep the first article of every URL key; all articles without URL share
    one key."""
    return keep_first(df, url_key(F.col(url)), ord_col)


def title_dedup(
    df: DataFrame, title: str = "title", ord_col: str = ORD, keep_empty_key: bool = False
) -> DataFrame:
    """Keep the first article of every title key.  Titles without a word longer
    than three letters share one key and collapse to one row;
    ``keep_empty_key=True`` keeps them all."""
    key = title_key(F.col(title))
    if not keep_empty_key:
        return keep_first(df, key, ord_col)
    return keep_first(
        df, F.when(key == "", F.concat(F.lit("\n"), F.col(ord_col).cast("string"))).otherwise(key),
        ord_col,
    )


def missing_required() -> Column:
    return is_blank(F.col("title")) | is_blank(F.col("url"))


def drop_missing_required(df: DataFrame) -> DataFrame:
    """Drop articles without title or URL."""
    return df.where(~missing_required())


def fill_defaults(df: DataFrame) -> DataFrame:
    """Defaults for optional fields that are null or exactly empty."""
    fills = {
        "author": default_if_empty(F.col("author"), R.DEFAULT_AUTHOR),
        "category": default_if_empty(F.col("category"), R.DEFAULT_CATEGORY),
        "summary": F.coalesce("summary", F.lit("")),
        "content": F.coalesce("content", F.lit("")),
        "tags": F.coalesce("tags", empty_strings()),
    }
    return df.withColumns({c: e for c, e in fills.items() if c in df.columns})


def standardize_dates(df: DataFrame, apply_offset: bool = False) -> DataFrame:
    """Date texts to timestamps; an unreadable publication date becomes the
    scrape date."""
    if apply_offset:
        published = article_date(F.col("published_at"), True)
        scraped = article_date(F.col("scraped_at"), True)
        return df.withColumns(
            {"published_at": F.coalesce(published, scraped), "scraped_at": scraped}
        )
    published = article_date_text(F.col("published_at"))
    scraped = article_date_text(F.col("scraped_at"))
    return df.withColumns(
        {
            "published_at": stored_timestamp(F.coalesce(published, scraped)),
            "scraped_at": stored_timestamp(scraped),
        }
    )


def normalize_texts(df: DataFrame, columns=TEXT_COLUMNS) -> DataFrame:
    return df.withColumns({c: normalize_text(F.col(c)) for c in columns if c in df.columns})


def validate_urls(df: DataFrame) -> DataFrame:
    """Keep http(s) URLs that name a host."""
    return df.where(is_http_url(F.col("url")))


def standard_category(c: Column, mapping: dict[str, str] | None = None) -> Column:
    """Exact entry of the map, else the first entry contained in the text, else
    the text in title case."""
    mapping = R.CATEGORY_MAP if mapping is None else mapping

    def mapped(key: Column) -> Column:
        exact = F.try_element_at(string_map(mapping), key)
        part = first_matching(key, [(v, (k,)) for k, v in mapping.items()], title_case(key))
        return F.coalesce(exact, part)

    return F.when(F.coalesce(c, F.lit("")) == "", R.DEFAULT_CATEGORY).otherwise(
        bind(strip(F.lower(c)), mapped)
    )


def standardize_category(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    if "category" not in df.columns:
        return df.withColumn("category", F.lit(R.DEFAULT_CATEGORY))
    return df.withColumn("category", standard_category(F.col("category"), mapping))


def clean_tags(df: DataFrame, limit: int = R.MAX_TAGS) -> DataFrame:
    tags = F.col("tags") if "tags" in df.columns else empty_strings()
    return df.withColumn("tags", clean_tag_list(tags, limit))


def derive_fields(df: DataFrame) -> DataFrame:
    """Content length in characters, content flag and URL hash."""
    length = F.length(F.coalesce("content", F.lit("")))
    return df.withColumns(
        {
            "content_length": length,
            "has_content": length > R.HAS_CONTENT_CHARS,
            "hash_id": hash_id(F.col("url"), R.HASH_ID_CHARS),
        }
    )


# ------------------------------------------------------- the row-dropping part
def _narrow(df: DataFrame) -> DataFrame:
    """What decides whether the first article of a URL survives: the key of the
    title rule and two flags -- no bodies."""
    return df.select(
        ORD,
        missing_required().alias("_missing"),
        (~is_http_url(F.col("url"))).alias("_invalid"),
        title_key(normalize_text(F.col("title"))).alias("_title_key"),
    )


def _first_by_url(df: DataFrame) -> DataFrame:
    """First row of every URL key, with the rows of the key (``n``).

    The minimum is one number, which is reduced by hashing; the flags of the
    rows chosen are joined back, narrow rows again.
    """
    first = (
        df.select(url_key(F.col("url")).alias("_url_key"), ORD)
        .groupBy("_url_key")
        .agg(F.count(F.lit(1)).alias("n"), F.min(ORD).alias(ORD))
        .select("n", ORD)
    )
    return _narrow(df).join(first, ORD)


def surviving_ords(df: DataFrame) -> DataFrame:
    """``_ord`` of the articles that pass all four row-dropping steps."""
    return (
        _first_by_url(df)
        .where(~F.col("_missing") & ~F.col("_invalid"))
        .groupBy("_title_key")
        .agg(F.min(ORD).alias(ORD))
        .select(ORD)
    )


def cleaning_report(df: DataFrame) -> DataFrame:
    """Rows before, after and removed for each of the four logged steps.

    Counted from the keys: how many rows share each URL key's first row, and
    which step drops that row.
    """
    per_url = _first_by_url(df)
    # a dropped row belongs to no title group
    group = F.when(~F.col("_missing") & ~F.col("_invalid"), F.col("_title_key"))
    per_title = per_url.groupBy(group.alias("_title_key")).agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("urls"),
        F.count_if("_missing").alias("missing"),
        F.count_if(~F.col("_missing") & F.col("_invalid")).alias("invalid"),
    )
    totals = per_title.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("urls"), F.lit(0)).alias("n1"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"),
        F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid"),
        F.count_if(F.col("_title_key").isNotNull()).alias("n4"),
    )
    n2 = F.col("n1") - F.col("missing")
    n3 = n2 - F.col("invalid")
    counts = [F.col("n0"), F.col("n1"), n2, n3, F.col("n4")]
    steps = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step"),
                F.lit(name).alias("operation"),
                counts[i].alias("before"),
                counts[i + 1].alias("after"),
                (counts[i] - counts[i + 1]).alias("removed"),
            )
            for i, name in enumerate(STEPS)
        ]
    )
    return totals.select(F.inline(steps)).withColumn("timestamp", F.current_timestamp())


def _with_image(df: DataFrame) -> Column:
    """The metadata with the image found for the article, if it names none."""
    kind = "map<string,variant>"
    given = F.try_variant_get("extra_data", "$", kind) if "extra_data" in df.columns else F.lit(None).cast(kind)
    given = F.coalesce(given, F.create_map().cast(kind))
    image = F.create_map(F.lit("image_url"), F.col("image_url").cast("variant"))
    own = F.try_variant_get("extra_data", "$.image_url", "string") if "extra_data" in df.columns else F.lit(None)
    rest = F.map_filter(given, lambda k, v: k != "image_url")
    kept = F.col("extra_data") if "extra_data" in df.columns else F.lit(None).cast("variant")
    return F.when(F.col("image_url").isNotNull() & own.isNull(),
                  F.to_variant_object(F.map_concat(rest, image))).otherwise(kept)


def to_records(df: DataFrame) -> DataFrame:
    """The columns stored in the article table; absent lists are empty."""
    lists = {c: F.coalesce(c, empty_strings()) for c in ("tags", "ai_keywords") if c in df.columns}
    df = df.withColumns(lists) if lists else df
    if "metadata" in df.columns:
        df = df.drop("extra_data").withColumnRenamed("metadata", "extra_data")
    if "image_url" in df.columns:
        df = df.withColumn("extra_data", _with_image(df))
    if "source" in df.columns:
        df = df.withColumnRenamed("source", "source_name")
    stored = (
        "source_name", "title", "url", "author", "published_at", "scraped_at", "content",
        "summary", "category", "tags", "hash_id", "content_length", "has_content",
        "ai_category", "ai_confidence", "ai_keywords", "sentiment", "sentiment_score",
        "extra_data", ORD,
    )
    return df.select(*[c for c in stored if c in df.columns])
