"""JSON stories: one object per line or per payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.functions.arrays import empty_strings
from newsflow.operators.cleaning import ORD
from newsflow.schemas import STORY
from newsflow.sources.conform import arrival, conform_article

# --- fixed values: item page, title prefixes, job words -----------------------
ITEM_PAGE = "https://news.ycombinator.com/item?id="
TITLE_PREFIXES = (("Ask HN:", "Ask HN"), ("Show HN:", "Show HN"), ("Tell HN:", "Tell HN"))
JOB_WORDS = ("hiring", "job")
_PLACE_BITS = 20  # places of one item; more crawls of it take the places behind and push later items on
_BUCKET_BITS = 10  # the rows of one item are numbered in so many parts


def story_category(title):
    """Category by title prefix (case-sensitive), then by job words."""
    lowered = F.lower(title)
    job = F.contains(lowered, F.lit(JOB_WORDS[0])) | F.contains(lowered, F.lit(JOB_WORDS[1]))
    chain = F
    for prefix, name in TITLE_PREFIXES:
        chain = chain.when(F.startswith(title, F.lit(prefix)), name)
    return chain.when(job, "Jobs").otherwise("General")


def _placed(items: DataFrame) -> DataFrame:
    """The distinct items with ``_ord``: by id, then by a hash of the item, then
    by its fields, so no two of them share a place.

    Items are numbered in parts of an id's hash range; the parts' first numbers
    come from one row per part.  An item with more rows than places takes whole
    containers more: there is at most one such item per ``2 ** _PLACE_BITS`` rows.
    """
    fields = [f.split()[0] for f in STORY.split(", ")]
    key, size = ["_item", "_part"], 1 << _PLACE_BITS
    distinct = (
        items.withColumn("_item", F.coalesce("id", F.lit(0)))
        .withColumn("_hash", F.xxhash64(*[f"`{f}`" for f in fields]))
        .withColumn("_part", F.shiftright("_hash", 64 - _BUCKET_BITS))
        .repartition(*key)
        .dropDuplicates([*key, "_hash", *fields])
    )
    sizes = distinct.groupBy(*key).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("_item").orderBy("_part")) - F.col("_rows")
    more = F.floor((F.sum("_rows") - 1) / size).alias("more")
    pushing = sizes.groupBy("_item").agg(more).where("more > 0").agg(
        F.collect_list(F.struct("_item", "more")).alias("_pushing"))
    inner = F.row_number().over(Window.partitionBy(*key).orderBy("_hash", *[f"`{f}`" for f in fields]))
    pushed = F.aggregate(
        F.filter("_pushing", lambda p: p["_item"] < F.col("_item")), F.lit(0).cast("bigint"), lambda n, p: n + p["more"])
    place = F.col("_before") + F.col("_inner") - 1
    order = arrival(
        F.col("_item") + pushed + F.shiftright(place, _PLACE_BITS), place.bitwiseAND(F.lit(size - 1)), _PLACE_BITS)
    return (
        distinct.withColumn("_inner", inner)
        .join(sizes.select(*key, before.alias("_before")), key)
        .crossJoin(F.broadcast(pushing))
        .withColumn(ORD, order)
        .drop(*key, "_hash", "_inner", "_before", "_pushing")
    )


def parse_stories(items: DataFrame, source: str = "hackernews") -> DataFrame:
    """Story rows to raw articles; anything but a story is dropped.

    Without ``_ord`` column the order of arrival is the item id, then a hash of
    the item: an item crawled again with another score has a place of its own,
    and rows equal in every field are one.  Items without id come first.
    """
    if ORD not in items.columns:
        items = _placed(items.where(F.col("type") == "story"))
    title = F.coalesce("title", F.lit(""))
    posted = F.timestamp_seconds(F.nullif(F.col("time"), F.lit(0)))
    articles = items.where(F.col("type") == "story").select(
        title.alias("title"),
        F.coalesce("url", F.concat(F.lit(ITEM_PAGE), F.col("id").cast("string"))).alias("url"),
        F.col("by").alias("author"),
        F.date_format(posted, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        F.coalesce("text", F.lit("")).alias("content"),
        story_category(title).alias("category"),
        empty_strings().alias("tags"),
        F.to_variant_object(
            F.struct(
                F.col("id").alias("hn_id"),
                F.coalesce("score", F.lit(0)).alias("score"),
                F.coalesce("descendants", F.lit(0)).alias("comments_count"),
                F.col("type").alias("type"),
            )
        ).alias("metadata"),
        # only stories that brought a URL are worth a page visit
        F.col("url").isNotNull().alias("_has_page"),
        ORD,
    )
    return conform_article(articles, source)


def stories_from_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Parse JSON texts; texts that are no JSON objects are dropped."""
    keep = [ORD] if ORD in payloads.columns else []
    items = payloads.select(*keep, F.from_json(column, STORY).alias("item"))
    return parse_stories(items.select(*keep, "item.*"))


def read_stories(spark: SparkSession, path: str) -> DataFrame:
    """Stories from JSON-lines files."""
    return parse_stories(spark.read.schema(STORY).json(path))
