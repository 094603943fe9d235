"""Posts inside nested JSON: every object that looks like a product post."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.functions.arrays import empty_strings
from newsflow.operators.cleaning import ORD
from newsflow.sources.cards import PRODUCT_SITE, POSITION_BITS
from newsflow.sources.conform import arrival, conform_article

MAX_DEPTH = 10
# --- fixed values: script elements that hold the page data --------------------
JSON_SCRIPT = r"(?is)<script\b[^<>]*\btype=[\"']application/json[\"'][^<>]*>(.*)\z"
NEXT_SCRIPT = r"(?is)<script\b[^<>]*\bid=[\"']__NEXT_DATA__[\"'][^<>]*>(.*)\z"
SCRIPT_END = r"(?i)</script>"


def page_json(pages: DataFrame, column: str = "html") -> DataFrame:
    """First script element of a page that holds readable JSON, as ``payload``
    text; pages without one drop."""
    # up to each closing tag, so that an element that is never closed ends there
    pieces = F.split(column, SCRIPT_END, -1)
    closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def contents(pattern):
        texts = F.transform(closed, lambda p: F.regexp_extract(p, pattern, 1))
        return F.filter(texts, lambda t: t != "")

    scripts = F.concat(contents(JSON_SCRIPT), contents(NEXT_SCRIPT))
    readable = F.filter(scripts, lambda s: F.try_parse_json(s).isNotNull())
    return pages.select(ORD, F.get(readable, F.lit(0)).alias("payload")).where(
        F.col("payload").isNotNull()
    )


def _text(path: str):
    return F.try_variant_get("node", path, "string")


def find_json_posts(
    payloads: DataFrame, column: str = "payload", source: str = "producthunt"
) -> DataFrame:
    """Articles for all objects with ``name``, ``tagline`` and ``slug`` down to
    ten levels below the root (a list counts as a level).

    Each step replaces a node by its children, and by itself if it is a post,
    so the whole search is one chain of narrow generate steps over a single
    parse of the payload, and only posts travel on.
    """
    nodes = payloads.select(
        F.col(ORD).alias("_page"),
        F.try_parse_json(column).alias("node"),
        F.lit(False).alias("seen"),
        F.array(F.lit(0)).alias("path"),
    ).where(F.col("node").isNotNull())
    members = F.try_variant_get("node", "$", "map<string,variant>")
    is_post = (
        F.map_contains_key(members, "name")
        & F.map_contains_key(members, "tagline")
        & F.map_contains_key(members, "slug")
    )
    children = F.coalesce(
        F.map_values(members),
        F.try_variant_get("node", "$", "array<variant>"),
        F.array().cast("array<variant>"),
    )
    itself = F.array(F.struct(F.col("node"), F.lit(True).alias("seen"), F.col("path")))
    below = F.transform(
        children,
        lambda c, i: F.struct(
            c.alias("node"), F.lit(False).alias("seen"),
            F.concat(F.col("path"), F.array(i)).alias("path"),
        ),
    )
    step = F.when(F.col("seen"), itself).otherwise(
        F.when(is_post, F.concat(itself, below)).otherwise(below)
    )
    for _ in range(MAX_DEPTH):
        nodes = nodes.select("_page", F.explode(step).alias("n")).select("_page", "n.*")
    posts = nodes.where(is_post)
    topics = F.transform(
        F.filter(
            F.try_variant_get("node", "$.topics", "array<variant>"),
            lambda t: F.schema_of_variant(t) == "STRING",
        ),
        lambda t: F.try_variant_get(t, "$", "string"),
    )
    articles = posts.select(
        _text("$.name").alias("title"),
        F.concat(
            F.lit(PRODUCT_SITE + "/posts/"), F.coalesce(_text("$.slug"), F.lit(""))
        ).alias("url"),
        _text("$.user.name").alias("author"),
        F.coalesce(
            F.nullif(_text("$.createdAt"), F.lit("")), _text("$.featuredAt")
        ).alias("published_at"),
        _text("$.tagline").alias("summary"),
        F.lit("Product Launch").alias("category"),
        F.coalesce(topics, empty_strings()).alias("tags"),
        F.to_variant_object(
            F.struct(
                F.coalesce(F.try_variant_get("node", "$.votesCount", "bigint"), F.lit(0)).alias(
                    "upvotes"
                ),
                F.coalesce(
                    F.try_variant_get("node", "$.commentsCount", "bigint"), F.lit(0)
                ).alias("comments_count"),
                F.lit("product").alias("type"),
            )
        ).alias("metadata"),
        F.col("_page"),
        F.col("path").alias("_path"),
    )
    # variant members have no document order; the path is the stable order
    within_page = F.row_number().over(Window.partitionBy("_page").orderBy("_path"))
    ranked = articles.withColumn(
        ORD, arrival(F.col("_page"), within_page - 1, POSITION_BITS)
    )
    return conform_article(ranked.drop("_page", "_path"), source)
