"""Listing pages: article cards, product cards, repository rows.

One Arrow-batched map over the pages finds the cards and returns their raw
texts; counts, categories, defaults and metadata are Spark expressions.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow import rules as R
from newsflow.functions.arrays import empty_strings
from newsflow.functions.text import compact_count, first_matching
from newsflow.operators.cleaning import ORD
from newsflow.sources.conform import conform_article
from newsflow.sources.html import Node, tree

# The card readers travel with the tasks, so executors need no copy of the package.
for _module in ("newsflow.sources.html", __name__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])

# --- fixed values: site addresses and class patterns --------------------------
PRODUCT_SITE = "https://www.producthunt.com"
REPO_SITE = "https://github.com"
REPO_IMAGE = "https://opengraph.githubassets.com/1/"
POST_CLASS = re.compile(r"post|article")
AUTHOR_CLASS = re.compile(r"author|byline")
EXCERPT_CLASS = re.compile(r"excerpt|summary|description")
PRODUCT_CLASS = re.compile(r"styles_item|post-item|product-card|styles_row", re.I)
PRODUCT_TEST = re.compile(r"post")
PRODUCT_LINK = re.compile(r"/posts/")
PRODUCT_SLUG = re.compile(r"/posts/[a-zA-Z0-9-]+$")
MAKER_CLASS = re.compile(r"maker|user|author")
TOPIC_CLASS = re.compile(r"topic|tag|category")
ROW_CLASS = re.compile(r"Box-row")
ROW_FALLBACK = re.compile(r"explore-content|Box-row")
REPO_TEXT_CLASS = re.compile(r"col-9|text-gray")
LANGUAGE_CLASS = re.compile(r"repo-language")
AVATAR_CLASS = re.compile(r"avatar|contributor")
RECENT_STARS = re.compile(r"stars today|stars this")
POSITION_BITS = 16  # cards per page
MAX_CONTRIBUTORS = 5  # looked at by default
PRODUCT_SUMMARY = 300
REPO_SUMMARY = 300


def article_cards(root: Node) -> Iterator[dict]:
    cards = list(root.all("article")) or list(root.all("div", cls=POST_CLASS))
    for card in cards:
        head = card.first("h2") or card.first("h3")
        link = head and (head.first("a") or card.first("a"))
        if not link or not head.text() or not link.attrs.get("href"):
            continue
        author, time = card.first(cls=AUTHOR_CLASS), card.first("time")
        summary = card.first(cls=EXCERPT_CLASS)
        yield {
            "title": head.text(),
            "url": link.attrs["href"],
            "author": author and author.text(),
            "published_at": time and time.attrs.get("datetime") or None,
            "summary": summary.text() if summary else "",
        }


def _product_boxes(root: Node) -> list[Node]:
    boxes = list(root.all("div", cls=PRODUCT_CLASS))
    boxes = boxes or list(root.all(**{"data-test": PRODUCT_TEST}))
    if not boxes:
        around = (a.up("div") for a in root.all("a", href=PRODUCT_SLUG))
        boxes = list(dict.fromkeys(box for box in around if box))
    return boxes


def product_cards(root: Node) -> Iterator[dict]:
    for box in _product_boxes(root):
        link = box.first("a", href=PRODUCT_LINK)
        if not link:
            continue
        title = (box.first("h3", "h2") or link).text()
        if not title:
            continue
        blurbs = (n.text() for n in box.all("p", "span"))
        maker, image = box.first(cls=MAKER_CLASS), box.first("img")
        source = image and (image.attrs.get("src") or image.attrs.get("srcset", "").split(" ")[0])
        topics = [n.text() for n in box.all(cls=TOPIC_CLASS)]
        yield {
            "title": title,
            "url": PRODUCT_SITE + link.attrs["href"],
            "author": maker and maker.text(),
            "summary": next((t for t in blurbs if len(t) > 20 and t != title), ""),
            "upvotes": next((t for t in box.texts() if re.search(r"^\d+$", t)), None),
            "image_url": source or None,
            "tags": [t for t in topics if t],
        }


def _says_recent(node: Node) -> bool:
    """The element itself, not one inside it, counts recent stars."""
    return any(isinstance(c, str) and RECENT_STARS.search(c) for c in node.children)


def repo_rows(root: Node) -> Iterator[dict]:
    for row in list(root.all("article", cls=ROW_CLASS)) or list(root.all("div", cls=ROW_FALLBACK)):
        head = row.first("h2") or row.first("h1")
        link = head and head.first("a")
        href = link.attrs.get("href", "").strip() if link else ""
        if href.count("/") < 2:
            continue
        language = row.first("span", itemprop=re.compile(r"^programmingLanguage$")) or row.first(
            "span", cls=LANGUAGE_CLASS
        )
        text = row.first("p", cls=REPO_TEXT_CLASS)
        stars = row.first("a", href=re.compile("/stargazers"))
        forks = row.first("a", href=re.compile("/forks"))
        recent = next((n for n in row.walk() if _says_recent(n)), None)
        if recent is not None and recent.tag != "span":
            recent = recent.up("span")
        people = [a.attrs.get("href", "") for a in row.all("a", cls=AVATAR_CLASS)]
        yield {
            "path": href,
            "description": text.text() if text else "",
            "language": language.text() if language else None,
            "stars": stars and stars.text(),
            "forks": forks and forks.text(),
            "today": recent and recent.text(),
            "avatars": people,
        }


def _place(order: int, position: int) -> int:
    """See ``conform.arrival``."""
    if position >> POSITION_BITS or abs(order) >> (63 - POSITION_BITS):
        raise OverflowError(f"card {position} of page {order}")
    return (order << POSITION_BITS) + position


def _explode_cards(
    pages: DataFrame, column: str, schema: str, find: Callable[[Node], Iterator[dict]]
) -> DataFrame:
    """One row per card; ``_ord`` is the page's order, then the position."""
    names = [f.split()[0] for f in schema.split(", ")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                [
                    {**card, ORD: _place(int(order), i)}
                    for order, page in zip(batch[ORD], batch[column])
                    for i, card in enumerate(find(tree(page)))
                ],
                columns=[*names, ORD],
            )

    return pages.select(ORD, column).mapInPandas(task, f"{schema}, {ORD} bigint")


def read_article_list_html(
    pages: DataFrame, column: str = "html", source: str = "techcrunch"
) -> DataFrame:
    """Article cards of listing pages; a card without title or link drops."""
    schema = "title string, url string, author string, published_at string, summary string"
    cards = _explode_cards(pages, column, schema, article_cards)
    return conform_article(
        cards.select(
            "*",
            F.lit(R.DEFAULT_CATEGORY).alias("category"),
            F.to_variant_object(F.struct(F.lit("web").alias("source_type"))).alias("metadata"),
        ),
        source,
    )


def read_product_cards_html(
    pages: DataFrame, column: str = "html", source: str = "producthunt"
) -> DataFrame:
    """Product cards.  Their publication date is unknown: it stays null and the
    cleaner fills it from the scrape date."""
    schema = (
        "title string, url string, author string, summary string, upvotes string, "
        "image_url string, tags array<string>"
    )
    cards = _explode_cards(pages, column, schema, product_cards)
    upvotes = F.coalesce(F.trim("upvotes").try_cast("bigint"), F.lit(0))
    return conform_article(
        cards.select(
            "title", "url", "author", "tags", ORD,
            F.substring("summary", 1, PRODUCT_SUMMARY).alias("summary"),
            F.lit("Product Launch").alias("category"),
            F.to_variant_object(
                F.struct(upvotes.alias("upvotes"), F.lit("product").alias("type"), "image_url")
            ).alias("metadata"),
        ),
        source,
    )


def repo_category(description):
    """Category of a repository by words of its description."""
    return first_matching(
        F.lower(F.coalesce(description, F.lit(""))), R.REPO_RULES, F.lit("Open Source")
    )


def read_repo_rows_html(
    pages: DataFrame, column: str = "html", source: str = "github_trending",
    max_contributors: int | None = MAX_CONTRIBUTORS,
) -> DataFrame:
    """Trending repository rows.  Address and image come from the row's own
    link, not from its contributors, of whom the first ``max_contributors`` (all
    if null) are looked at."""
    schema = (
        "path string, description string, language string, stars string, forks string, "
        "today string, avatars array<string>"
    )
    rows = _explode_cards(pages, column, schema, repo_rows)
    owner_repo = F.regexp_replace("path", r"\A/+|/+\z", "")
    avatars = F.col("avatars") if max_contributors is None else F.slice("avatars", 1, max_contributors)
    people = F.filter(
        F.transform(
            F.filter(avatars, lambda a: ~F.startswith(a, F.lit("http"))),
            lambda a: F.regexp_replace(a, r"\A/+|/+\z", ""),
        ),
        lambda a: (a != "") & ~F.contains(a, F.lit("/")),
    )
    today = F.replace(F.regexp_extract("today", r"([\d,]+)", 1), F.lit(","), F.lit(""))
    language = F.coalesce("language", F.lit("Unknown"))
    rows = rows.select(
        "path", "description", ORD,
        owner_repo.alias("owner_repo"), people.alias("built_by"), language.alias("language"),
        compact_count(F.col("stars")).alias("stars"),
        compact_count(F.col("forks")).alias("forks"),
        F.coalesce(today.try_cast("bigint"), F.lit(0)).alias("today_stars"),
    )
    return conform_article(
        rows.select(
            ORD,
            F.replace("owner_repo", F.lit("/"), F.lit(" / ")).alias("title"),
            F.concat(F.lit(REPO_SITE), "path").alias("url"),
            F.coalesce(
                F.get("built_by", F.lit(0)), F.substring_index("owner_repo", "/", 1)
            ).alias("author"),
            F.col("description").alias("content"),
            F.substring("description", 1, REPO_SUMMARY).alias("summary"),
            repo_category(F.col("description")).alias("category"),
            F.when(F.col("language") != "Unknown", F.array("language"))
            .otherwise(empty_strings())
            .alias("tags"),
            F.to_variant_object(
                F.struct(
                    "stars", "forks", "today_stars", "language", "built_by",
                    F.lit("repository").alias("type"),
                    F.concat(F.lit(REPO_IMAGE), "owner_repo").alias("image_url"),
                )
            ).alias("metadata"),
        ),
        source,
    )
