"""One query per operator over the generic test tables.

Every query reads whole tables.  Lists are joined to strings, long texts are
hashed and averages rounded, so results compare across engines.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow import rules as R
from newsflow import views as V
from newsflow.functions import text as T
from newsflow.functions import urls as U
from newsflow.functions.dates import article_date_text
from newsflow.functions.sql import register_functions
from newsflow.operators import analytics as A
from newsflow.operators import cleaning as C
from newsflow.operators import enrich as E
from newsflow.operators import joins as J
from newsflow.operators import pages as P
from newsflow.operators import tables as M
from newsflow.plans.batch import interleave_sources, run_all
from newsflow.plans.clean import clean_articles
from newsflow.schemas import STORY
from newsflow.session import fresh_path, staged
from newsflow.sources import cards, feeds, posts, registry, stories
from newsflow.sources.conform import conform_article, union_feeds
from newsflow.streaming.ingest import read_quarantine, stream_dedup, stream_ingest, stream_unique
from newsflow.streaming.monitor import METRICS, RunLog, run_status, source_health

ORD = C.ORD
NOW = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)
# rules and words that occur in the test corpus, beside the default ones
CORPUS_RULES = (
    R.Category("Articles", 2.0, ("the", "la", "the", "der")),
    R.Category("Linking", 1.5, ("and", "of the", "und", "with")),
    R.Category("Pointing", 1.0, ("that", "this", "in", "que")),
    R.Category("Rare", 1.3, ("zzz", "ment", "ion")),
)
CORPUS_LEXICON = R.Lexicon(
    positive=("the", "and", "la", "und"), negative=("of", "that", "que", "nicht", "with")
)
CORPUS_BOOST = ("with", "that", "thin", "from")
CORPUS_COMPANIES = ("thin", "er", "zzz", "menta", "ing")


# ------------------------------------------------------------------ test views
def raw(spark: SparkSession, sf: str) -> DataFrame:
    return V.articles_from_documents(spark, sf)


_TABLES: dict[tuple[str, str], DataFrame] = {}


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """The article table the read queries run on.

    As in production it is stored: the first query of a session enriches and
    writes it (see ``article_table`` for that job's own result), later ones
    scan the columns they need.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TABLES:
        _TABLES[key] = staged(article_rows(spark, sf), "articles")
    return _TABLES[key]


def article_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Enriched articles without deduplication."""
    clean = (
        raw(spark, sf)
        .transform(C.fill_defaults)
        .transform(C.standardize_dates)
        .transform(C.standardize_category)
        .transform(C.clean_tags)
        .transform(C.derive_fields)
        .transform(E.enrich, rules=CORPUS_RULES, lexicon=CORPUS_LEXICON)
    )
    return (
        C.to_records(clean)
        .withColumn("id", F.col(ORD) + 1)
        .withColumn(
            "generated_at",
            F.when(F.col(ORD) % 50 != 7, F.timestamp_seconds(1704067200 + (F.col(ORD) * 7919) % 500000)),
        )
    )


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """A target table: two thirds of the articles, already stored."""
    rows = articles(spark, sf).where(F.col(ORD) % 3 != 2)
    return rows.select(
        *[c for c in rows.columns if c not in (ORD, "id")],
        F.lit(None).cast("int").alias("source_id"),
        F.lit(NOW - dt.timedelta(days=9)).alias("created_at"),
        F.lit(NOW - dt.timedelta(days=9)).alias("updated_at"),
    )


def incoming(spark: SparkSession, sf: str) -> DataFrame:
    """A batch: every second article, some twice, some known by URL only, some
    without title."""
    rows = articles(spark, sf).where(F.col(ORD) % 2 == 0).drop("id", "generated_at")
    again = rows.where(F.col(ORD) % 10 == 0).withColumns(
        {"title": F.concat("title", F.lit(" (again)")), ORD: F.col(ORD) + (1 << 40)}
    )
    both = rows.unionByName(again)
    return both.withColumns(
        {
            "hash_id": F.when(F.col(ORD) % 7 == 0, F.concat(F.lit("other"), F.col("hash_id")))
            .otherwise(F.col("hash_id")),
            "title": F.when(F.col(ORD) % 26 != 0, F.col("title")),
        }
    )


def sources_of(spark: SparkSession, sf: str) -> DataFrame:
    """Registered sources: those named in the documents, except some."""
    names = V.table(spark, sf, "documents").select("source").distinct()
    number = F.replace("source", F.lit("src"), F.lit("")).cast("int")
    return names.where(number % 4 != 3).select(
        (number + 1).alias("id"),
        F.col("source").alias("name"),
        F.initcap("source").alias("display_name"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com")).alias("url"),
        F.lit("").alias("description"),
        (number % 2 == 0).alias("is_active"),
        F.lit(6).alias("scrape_frequency_hours"),
    )


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, "|") for c in columns})


def _stamp(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns}
    )


# --------------------------------------------------------------------- sources
def story_payloads(spark, sf):
    title = F.substring(F.regexp_extract("text", r"^([^.\n]*)", 1), 1, 120)
    kind = F.col("doc_id") % 6
    headed = (
        F.when(kind == 0, F.concat(F.lit("Ask HN: "), title))
        .when(kind == 1, F.concat(F.lit("Show HN: "), title))
        .when(kind == 2, F.concat(F.lit("Tell HN: "), title))
        .when(kind == 3, F.concat(title, F.lit(" is Hiring")))
        .when(kind == 4, F.concat(F.lit("ask hn: "), title))
        .otherwise(title)
    )
    item = F.struct(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 7 == 0, "comment").otherwise("story").alias("type"),
        headed.alias("title"),
        F.when(
            F.col("doc_id") % 4 != 0,
            F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string")),
        ).alias("url"),
        F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("by"),
        (F.lit(1704067200) + F.col("doc_id") * 61).alias("time"),
        F.when(F.col("doc_id") % 8 != 0, F.col("n_chars")).alias("score"),
        (F.col("n_chars") % 50).alias("descendants"),
        "text",
    )
    return V.documents(spark, sf).select(F.col("doc_id").alias(ORD), F.to_json(item).alias("payload"))


def q_stories(spark, sf):
    return stories.stories_from_payloads(story_payloads(spark, sf)).select(
        F.col(ORD).alias("story_id"), "title", "url", "author", "category",
        "published_at", F.md5("content").alias("content_md5"),
        F.variant_get("metadata", "$.score", "bigint").alias("score"),
        F.variant_get("metadata", "$.comments_count", "bigint").alias("comments_count"),
    )


def q_read_stories(spark, sf):
    """The same stories from JSON-lines files; their order is the item's."""
    folder = fresh_path(spark, "stories")
    items = story_payloads(spark, sf).select(F.from_json("payload", STORY).alias("i")).select("i.*")
    items.write.json(folder)
    return stories.read_stories(spark, folder).select(
        F.variant_get("metadata", "$.hn_id", "bigint").alias("story_id"), "title", "url", "author", "category",
        "published_at", F.md5("content").alias("content_md5"),
        F.variant_get("metadata", "$.score", "bigint").alias("score"),
        F.variant_get("metadata", "$.comments_count", "bigint").alias("comments_count"),
    )


def rss_payloads(spark, sf):
    title = F.regexp_extract("text", r"^([^.\n]*)", 1)
    escaped = F.replace("text", F.lit("&"), F.lit("&amp;amp;"))
    zone = F.when(F.col("doc_id") % 2 == 0, "+0000").otherwise("+0530")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))
    item = F.concat(
        F.lit("<item><title>"), F.replace(title, F.lit("&"), F.lit("&amp;")),
        F.when(F.col("doc_id") % 5 == 0, " gaming").otherwise(""),
        F.lit("</title><link>"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(
            F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string"))
        ),
        F.lit("</link>"),
        F.when(
            F.col("doc_id") % 3 != 0,
            F.concat(F.lit("<dc:creator>"), "source", F.lit("</dc:creator>")),
        ).otherwise("<author><name>Desk</name></author>"),
        F.lit("<pubDate>"), F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 07:08:09 "), zone,
        F.lit("</pubDate><description>&lt;p&gt; "), escaped, F.lit(" &lt;/p&gt;</description>"),
        F.when(
            F.col("doc_id") % 4 != 0,
            F.concat(
                F.lit("<category>"), "lang", F.lit("</category><category>"), "source",
                F.lit("</category><category>"), "lang", F.lit("</category>"),
            ),
        ).otherwise(""),
        F.when(
            F.col("doc_id") % 2 == 0,
            F.concat(F.lit('<media:content url="https://img.example.com/'), F.col("doc_id").cast("string"), F.lit('.png"/>')),
        ).otherwise(""),
        F.lit("<content:encoded>&lt;div&gt;"), escaped,
        F.lit("&lt;br/&gt; end&lt;/div&gt;</content:encoded></item>"),
    )
    return V.documents(spark, sf).select(F.col("doc_id").alias(ORD), item.alias("payload"))


def _rss_view(df):
    return _joined(df, "tags").select(
        F.col(ORD).alias("doc_id"), "title", "url", "author", "published_at", "category", "tags",
        "image_url", F.md5("summary").alias("summary_md5"), F.md5("content").alias("content_md5"),
    )


def q_rss_items(spark, sf):
    return _rss_view(feeds.rss_articles(feeds.items_from_payloads(rss_payloads(spark, sf))))


def _feed_files(spark, sf):
    """The items as feed files, many items in each: one for every part of the scan."""
    folder = fresh_path(spark, "feeds")
    rss_payloads(spark, sf).select("payload").write.text(folder)
    return folder


def q_read_rss(spark, sf):
    """Feed files, cut into items by the reader."""
    return _rss_view(feeds.read_rss(spark, _feed_files(spark, sf))).drop("doc_id")


def q_read_rss_categorised(spark, sf):
    return _rss_view(feeds.read_rss_categorised(spark, _feed_files(spark, sf), "Enterprise")).drop("doc_id")


def q_rss_categorised(spark, sf):
    items = feeds.items_from_payloads(rss_payloads(spark, sf))
    return _rss_view(feeds.rss_articles_categorised(items, "Enterprise"))


def listing_pages(spark, sf):
    """A listing page per document, holding all three kinds of cards."""
    d = F.col("doc_id").cast("string")
    text = F.replace(F.replace("text", F.lit("&"), F.lit("and")), F.lit("<"), F.lit("("))
    page = F.concat(
        F.lit("<html><body><article class='Box-row'><h2><a href='/"), "lang", F.lit("/repo"), d,
        F.lit("'>name</a></h2><p class='col-9'> "), text,
        F.when(F.col("doc_id") % 3 == 0, " web server").otherwise(""),
        F.lit(" </p><span itemprop='programmingLanguage'>"), "source",
        F.lit("</span><a href='/x/stargazers'> "),
        F.format_number(F.col("n_chars") * 3, 0), F.lit("</a><a href='/x/forks'>"),
        F.format_number(F.floor(F.col("n_chars") / 100) / 10, 1), F.lit("k</a><span class='a'><b>+</b>"),
        (F.col("n_chars") % 70).cast("string"), F.lit(" stars today</span>"),
        F.lit("<a class='avatar' href='/user"), d, F.lit("'></a>"),
        F.lit("<div class='byline'>By <b>"), "source", F.lit("</b></div>"),
        F.lit("<time datetime='2024-02-03'>x</time><div class='excerpt'><div>"),
        text, F.lit("</div></div></article>"),
        F.lit("<div class='post-item x'><div><a href='/posts/p"), d, F.lit("'><h3>Product "), d,
        F.lit("</h3></a></div><p>short</p><p>"), text,
        F.lit(" and enough words</p><span>"), (F.col("n_chars") % 90).cast("string"),
        F.lit("</span><em class='topic'>"), "lang", F.lit("</em><em class='topic'>"), "source",
        F.lit("</em><i class='maker'>m"), d, F.lit("</i></div></body></html>"),
    )
    return V.documents(spark, sf).select(F.col("doc_id").alias(ORD), page.alias("html"))


def _page_id(order=ORD):
    return F.shiftright(F.col(order), cards.POSITION_BITS).alias("doc_id")


def q_article_cards(spark, sf):
    return cards.read_article_list_html(listing_pages(spark, sf)).select(
        _page_id(), "title", "url", "author", "published_at", "category",
        F.md5("summary").alias("summary_md5"),
    )


def q_product_cards(spark, sf):
    return _joined(cards.read_product_cards_html(listing_pages(spark, sf)), "tags").select(
        _page_id(), "title", "url", "author", "tags", "category",
        F.md5("summary").alias("summary_md5"),
        F.variant_get("metadata", "$.upvotes", "bigint").alias("upvotes"),
    )


def q_repo_rows(spark, sf):
    return _joined(cards.read_repo_rows_html(listing_pages(spark, sf)), "tags").select(
        _page_id(), "title", "url", "author", "tags", "category",
        F.md5("content").alias("content_md5"),
        *[
            F.variant_get("metadata", f"$.{m}", "bigint").alias(m)
            for m in ("stars", "forks", "today_stars")
        ],
    )


def json_pages(spark, sf):
    d = F.col("doc_id").cast("string")
    post = F.struct(
        F.concat(F.lit("Post "), d).alias("name"), F.col("lang").alias("tagline"),
        F.concat(F.lit("p"), d).alias("slug"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("2024-01-05T00:00:00Z")).alias("createdAt"),
        F.lit("2024-01-06").alias("featuredAt"),
        F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("votesCount"),
        F.array("lang", "source").alias("topics"),
        F.struct(F.col("source").alias("name")).alias("user"),
    )
    inner = F.struct(F.concat(F.lit("Inner "), d).alias("name"), F.lit("t").alias("tagline"),
                     F.concat(F.lit("i"), d).alias("slug"))
    data = F.struct(
        F.struct(F.array(post).alias("edges"), F.lit(1).alias("n")).alias("props"),
        F.array(F.array(F.struct(F.struct(inner.alias("x")).alias("deep")))).alias("lists"),
        F.struct(F.lit("no slug").alias("name"), F.lit("t").alias("tagline")).alias("partial"),
    )
    html = F.concat(
        F.lit('<html><script type="application/json">{broken</script>'),
        F.lit('<script type="application/json">'), F.to_json(data), F.lit("</script></html>"),
    )
    return V.documents(spark, sf).select(F.col("doc_id").alias(ORD), html.alias("html"))


def q_json_posts(spark, sf):
    found = posts.find_json_posts(posts.page_json(json_pages(spark, sf)))
    return _joined(found, "tags").select(
        _page_id(), "title", "url", "author", "published_at", "summary", "tags",
        F.variant_get("metadata", "$.upvotes", "bigint").alias("upvotes"),
    )


def q_compact_counts(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.format_number(cents, 0))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.format_number(F.floor(cents / 1000) / 10, 1), F.lit("K")))
        .when(F.col("o_orderkey") % 4 == 2, F.col("o_orderpriority"))
        .otherwise(F.concat(F.lit(" "), cents.cast("string"), F.lit(" ")))
    )
    return V.table(spark, sf, "orders").select(
        "o_orderkey", T.compact_count(text).alias("n")
    )


def q_union_feeds(spark, sf):
    docs = raw(spark, sf).withColumn("url", F.regexp_replace("url", r"[0-9]+/?$", ""))
    parts = [docs.where(F.col(ORD) % 3 == i) for i in range(3)]
    merged = union_feeds(parts, ["daily", "weekly", "monthly"])
    position = F.col(ORD).bitwiseAND(F.lit((1 << 48) - 1))
    return merged.select("url", position.alias("doc_id"), "timespan")


def q_conform_article(spark, sf):
    odd = raw(spark, sf).withColumns(
        {"title": F.when(F.col(ORD) % 6 == 0, "  ").otherwise(F.col("title")),
         "summary": F.when(F.col(ORD) % 5 == 0, F.lit(None)).otherwise(F.col("summary"))}
    ).drop("tags")
    return _joined(conform_article(odd, F.col("source")), "tags").select(
        F.col(ORD).alias("doc_id"), "source", "title", "url", "author", "published_at",
        "category", "tags", F.md5("summary").alias("summary_md5"),
    )


def q_register_sources(spark, sf):
    return registry.register_sources(sources_of(spark, sf)).select(
        "id", "name", "display_name", "url", "is_active", "scrape_frequency_hours"
    )


def q_list_sources(spark, sf):
    return registry.list_sources(sources_of(spark, sf))


# ----------------------------------------------------------------------- pages
def q_page_metadata(spark, sf):
    meta = P.page_metadata(
        V.pages(spark, sf).withColumn(
            "html",
            F.when(
                F.col("page_id") % 3 == 0,
                F.replace("html", F.lit("</head>"), F.lit('<meta property="og:image" content="https://img/a&amp;b.png"></head>')),
            )
            .when(
                F.col("page_id") % 3 == 1,
                F.replace("html", F.lit("</head>"), F.lit('<meta content="https://img/t.png" name="twitter:image"></head>')),
            )
            .otherwise(F.col("html")),
        )
    )
    return meta.select("page_id", "image_url", "page_title", "page_lang", "page_host")


def q_page_main_text(spark, sf):
    return P.page_main_text(V.pages(spark, sf)).select(
        "page_id", F.length("page_text").alias("n_chars"), F.md5("page_text").alias("text_md5")
    )


def _page_texts(spark, sf):
    return P.page_main_text(P.page_metadata(V.pages(spark, sf))).select(
        "url", "page_text", "image_url", ORD
    )


def _linked_items(spark, sf):
    """Feed items that point at pages: each page is named by several documents,
    the first page by a third of them."""
    n = V.table(spark, sf, "pages").agg(F.count(F.lit(1))).scalar()
    link = F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.col("doc_id") % n)
    items = V.documents(spark, sf).select(
        F.col("doc_id").alias(ORD), link.alias("page_id"),
        F.when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 2, F.concat(
            F.lit("Note "), F.col("doc_id").cast("string"))).otherwise(F.col("text")).alias("content"),
        F.when(F.col("doc_id") % 5 == 0, "https://img/own.png").alias("image_url"),
    )
    urls = V.table(spark, sf, "pages").select("page_id", "url")
    return items.join(urls, "page_id")


def q_enrich_feed_content(spark, sf):
    out = J.enrich_content(
        _linked_items(spark, sf), _page_texts(spark, sf).withColumn("image_url", F.lit("https://img/page.png")),
        hot_rows=200,
    )
    return out.select(F.col(ORD).alias("doc_id"), "image_url", F.md5("content").alias("content_md5"))


def q_enrich_story_content(spark, sf):
    items = _linked_items(spark, sf).drop("image_url").withColumn(
        "_has_page", F.col(ORD) % 4 != 0
    ).withColumn("content", F.when(F.col(ORD) % 2 == 0, F.col("content")))
    out = J.enrich_content(items, _page_texts(spark, sf), mode="story", hot_rows=200)
    return out.select(F.col(ORD).alias("doc_id"), F.md5("content").alias("content_md5"))


# -------------------------------------------------------------------- cleaning
def q_url_dedup(spark, sf):
    return C.url_dedup(V.pages(spark, sf)).select(
        "page_id", "url", U.url_key(F.col("url")).alias("url_key")
    )


def _gappy(spark, sf):
    """Raw articles with gaps and odd URLs."""
    return raw(spark, sf).withColumns(
        {
            "title": F.when(F.col(ORD) % 13 == 0, " \t").when(F.col(ORD) % 17 == 0, F.lit(None))
            .otherwise(F.col("title")),
            "url": F.when(F.col(ORD) % 19 == 0, F.lit(None))
            .when(F.col(ORD) % 23 == 0, F.concat(F.lit("ftp://"), "url"))
            .when(F.col(ORD) % 29 == 0, "https:///nohost")
            .otherwise(F.col("url")),
        }
    )


def q_drop_missing_required(spark, sf):
    return C.drop_missing_required(_gappy(spark, sf)).select(F.col(ORD).alias("doc_id"), "title", "url")


def q_validate_urls(spark, sf):
    return C.validate_urls(_gappy(spark, sf)).select(F.col(ORD).alias("doc_id"), "url")


def q_fill_defaults(spark, sf):
    return C.fill_defaults(raw(spark, sf)).select(F.col(ORD).alias("doc_id"), "author", "category")


def q_standardize_dates(spark, sf):
    out = raw(spark, sf).withColumn("iso", article_date_text(F.col("published_at")))
    return _stamp(C.standardize_dates(out), "published_at", "scraped_at").select(
        F.col(ORD).alias("doc_id"), "iso", "published_at", "scraped_at"
    )


def q_standardize_dates_offset(spark, sf):
    return _stamp(C.standardize_dates(raw(spark, sf), apply_offset=True), "published_at").select(
        F.col(ORD).alias("doc_id"), "published_at"
    )


def q_normalize_text(spark, sf):
    return C.normalize_texts(raw(spark, sf)).select(
        F.col(ORD).alias("doc_id"), F.length("content").alias("n_chars"),
        F.md5("content").alias("content_md5"), F.md5("title").alias("title_md5"),
    )


def q_standardize_category(spark, sf):
    return C.standardize_category(raw(spark, sf)).select(F.col(ORD).alias("doc_id"), "category")


def q_clean_tags(spark, sf):
    return _joined(C.clean_tags(raw(spark, sf)), "tags").select(F.col(ORD).alias("doc_id"), "tags")


def q_title_dedup(spark, sf):
    return C.title_dedup(raw(spark, sf)).select(
        F.col(ORD).alias("doc_id"), T.title_key(F.col("title")).alias("title_key")
    )


def q_title_dedup_keep_empty(spark, sf):
    return C.title_dedup(raw(spark, sf), keep_empty_key=True).select(F.col(ORD).alias("doc_id"))


def q_derive_fields(spark, sf):
    return C.derive_fields(raw(spark, sf)).select(
        F.col(ORD).alias("doc_id"), "content_length", "has_content", "hash_id"
    )


def q_cleaning_report(spark, sf):
    return C.cleaning_report(_gappy(spark, sf)).select("step", "operation", "before", "after", "removed")


def q_clean_articles(spark, sf):
    return _joined(_stamp(clean_articles(_gappy(spark, sf), ai=False), "published_at"), "tags").select(
        F.col(ORD).alias("doc_id"), "source", "title", "url", "author", "published_at", "category",
        "tags", "hash_id", "content_length", "has_content",
    )


def q_to_records(spark, sf):
    out = C.to_records(clean_articles(raw(spark, sf)))
    return _joined(out, "tags", "ai_keywords").select(
        "hash_id", "source_name", "title", "url", "category", "tags", "ai_keywords", "has_content",
        F.variant_get("extra_data", "$.score", "bigint").alias("score"),
    )


def q_clean_pages(spark, sf):
    """The flagship job: stored pages to clean, enriched articles."""
    out = clean_articles(V.articles_from_pages(spark, sf))
    return _joined(out, "ai_keywords").select(
        F.col(ORD).alias("page_id"), "source", "title", "hash_id", "content_length",
        "ai_category", F.round("ai_confidence", 6).alias("ai_confidence"), "ai_keywords",
        "sentiment", F.round("sentiment_score", 6).alias("sentiment_score"),
    )


# -------------------------------------------------------------- text analytics
def _verdicts(df, rules, current=None):
    verdict = E.categorize(F.col("title"), F.col("content"), current, rules)
    return df.select(
        F.col(ORD).alias("doc_id"), verdict.alias("v")
    ).select("doc_id", F.col("v.category").alias("category"),
             F.round("v.confidence", 6).alias("confidence"))


def q_categorize(spark, sf):
    return _verdicts(raw(spark, sf), R.CATEGORY_RULES)


def q_categorize_corpus_rules(spark, sf):
    return _verdicts(raw(spark, sf), CORPUS_RULES, F.col("category"))


def _news_items(spark, sf):
    """Feed items as they come: the first sentence as title, the whole text."""
    return V.documents(spark, sf).select(
        F.col("doc_id").alias(ORD), F.regexp_extract("text", r"^([^.\n]*)", 1).alias("title"), F.col("text").alias("content"))


def q_categorize_news_items(spark, sf):
    return _verdicts(_news_items(spark, sf), R.CATEGORY_RULES)


def q_keywords_news_items(spark, sf):
    words = E.keywords(F.concat_ws(" ", "title", "content"), 5)
    return _news_items(spark, sf).select(F.col(ORD).alias("doc_id"), F.array_join(words, "|").alias("keywords"))


def q_categorize_cleaned(spark, sf):
    out = E.add_category(raw(spark, sf))
    return out.select(
        F.col(ORD).alias("doc_id"), "ai_category", F.round("ai_confidence", 6).alias("ai_confidence")
    )


def q_recategorize(spark, sf):
    thin = raw(spark, sf).withColumn(
        "content", F.when(F.col(ORD) % 2 == 0, "").otherwise(F.col("content"))
    )
    return E.recategorize(thin, CORPUS_RULES).select(
        F.col(ORD).alias("doc_id"), "category", "ai_confidence"
    )


def q_keywords(spark, sf):
    words = E.keywords(F.col("text"))
    return V.documents(spark, sf).select("doc_id", F.array_join(words, "|").alias("keywords"))


def q_keywords_boosted(spark, sf):
    df = E.add_keywords(raw(spark, sf), boosted=CORPUS_BOOST)
    return df.select(F.col(ORD).alias("doc_id"), F.array_join("ai_keywords", "|").alias("keywords"))


def q_conversation_keywords(spark, sf):
    turns = V.conversations(spark, sf)
    return turns.select(
        "conv_id", "turn", F.array_join(E.keywords(F.col("text"), 3), "|").alias("keywords")
    )


def q_entities(spark, sf):
    priced = F.concat("text", F.lit(" raised $"), F.col("n_chars").cast("string"), F.lit(",5.25 million, $7 B"))
    found = E.entities(priced, R.COMPANIES + CORPUS_COMPANIES)
    return V.documents(spark, sf).select("doc_id", found.alias("e")).select(
        "doc_id", F.array_join("e.companies", "|").alias("companies"),
        F.array_join("e.technologies", "|").alias("technologies"),
        F.array_join("e.amounts", "|").alias("amounts"),
    )


def _moods(spark, sf, lexicon):
    mood = E.sentiment(F.col("text"), lexicon)
    return V.documents(spark, sf).select("doc_id", mood.alias("m")).select(
        "doc_id", F.col("m.label").alias("label"), F.col("m.positive").alias("positive"),
        F.col("m.negative").alias("negative"), F.round("m.confidence", 6).alias("confidence"),
    )


def q_sentiment(spark, sf):
    return _moods(spark, sf, R.Lexicon())


def q_sentiment_corpus_words(spark, sf):
    return _moods(spark, sf, CORPUS_LEXICON)


def q_enrich(spark, sf):
    out = _joined(E.enrich(raw(spark, sf), CORPUS_RULES, CORPUS_LEXICON), "ai_keywords")
    return out.select(
        F.col(ORD).alias("doc_id"), "ai_category", F.round("ai_confidence", 6).alias("ai_confidence"),
        "ai_keywords", "sentiment", F.round("sentiment_score", 6).alias("sentiment_score"),
    )


def q_article_table(spark, sf):
    """The rows of the stored article table."""
    out = _joined(_stamp(article_rows(spark, sf), "published_at", "generated_at"), "tags", "ai_keywords")
    return out.select(
        "id", "hash_id", "published_at", "generated_at", "category", "tags", "ai_category",
        F.round("ai_confidence", 6).alias("ai_confidence"), "ai_keywords", "sentiment",
        F.round("sentiment_score", 6).alias("sentiment_score"),
    )


def q_confident_count(spark, sf):
    return E.confident_count(E.add_category(raw(spark, sf), CORPUS_RULES))


# ----------------------------------------------------------------------- joins
def q_resolve_source(spark, sf):
    out = J.resolve_source(C.to_records(raw(spark, sf)), sources_of(spark, sf))
    return out.select(F.col(ORD).alias("doc_id"), "source_name", "source_id")


def q_split_new_vs_existing(spark, sf):
    new, known = J.split_new_vs_existing(incoming(spark, sf), stored(spark, sf))
    both = new.select(ORD, F.lit("new").alias("kind"), F.lit("").alias("target")).unionByName(
        known.select(ORD, F.lit("known").alias("kind"), F.col("_target").alias("target"))
    )
    return both.withColumnRenamed(ORD, "row_id")


# ---------------------------------------------------------------- aggregations
def q_stats_total(spark, sf):
    return A.stats_total(articles(spark, sf))


def q_stats_by_source(spark, sf):
    return A.stats_by_source(articles(spark, sf))


def q_stats_by_category(spark, sf):
    return A.stats_by_category(articles(spark, sf))


def q_last_scraped(spark, sf):
    return _stamp(
        A.last_scraped(V.runs_from_events(spark, sf), articles(spark, sf)), "last_scraped"
    )


def q_last_scraped_without_runs(spark, sf):
    unfinished = V.runs_from_events(spark, sf).where(F.col("status") == "running")
    return _stamp(A.last_scraped(unfinished, articles(spark, sf)), "last_scraped")


def q_is_scraping(spark, sf):
    return A.is_scraping(V.runs_from_events(spark, sf))


def q_sentiment_distribution(spark, sf):
    return A.sentiment_distribution(articles(spark, sf))


def q_total_analyzed(spark, sf):
    return A.total_analyzed(articles(spark, sf))


def q_ai_categories(spark, sf):
    return A.ai_categories(articles(spark, sf))


def q_confidence_by_category(spark, sf):
    return A.confidence_by_category(articles(spark, sf))


def q_top_keywords(spark, sf):
    return A.top_keywords(articles(spark, sf))


def q_insights(spark, sf):
    return A.insights(articles(spark, sf)).withColumn("value", F.round("value", 2))


def q_dashboard_kpis(spark, sf):
    return A.dashboard_kpis(articles(spark, sf))


# ------------------------------------------------------------------ list views
def _view(df, *extra):
    return _joined(_stamp(df, "published_at"), "tags").select(
        "id", "hash_id", "source_name", "title", "url", "author", "published_at",
        F.md5("summary").alias("summary_md5"), "category", "tags", *extra,
    )


def q_article_by_id(spark, sf):
    return _view(articles(spark, sf).transform(A.article_by_id, 42), "ai_category", "sentiment")


def q_article_summaries(spark, sf):
    return _view(A.to_summary(articles(spark, sf)), "ai_category", "sentiment")


def q_article_feed(spark, sf):
    return _view(A.article_feed(articles(spark, sf), page=2), "total", "filtered_total", "has_more")


def q_article_feed_filtered(spark, sf):
    page = A.article_feed(
        articles(spark, sf), source="src3", category="Ask Hn", page_size=5, order_by="scraped_at"
    )
    return _view(page, "total", "filtered_total", "has_more")


def q_trending(spark, sf):
    return _view(A.trending(articles(spark, sf)), "trend_score")


def q_articles_positive(spark, sf):
    return _view(
        A.articles_by_sentiment(articles(spark, sf), "positive", 15),
        F.round("sentiment_score", 6).alias("sentiment_score"),
    )


def q_articles_negative(spark, sf):
    return _view(
        A.articles_by_sentiment(articles(spark, sf), "negative", 15),
        F.round("sentiment_score", 6).alias("sentiment_score"),
    )


def q_latest_ticker(spark, sf):
    return _stamp(A.latest_ticker(articles(spark, sf)), "published_at")


def q_ticker(spark, sf):
    return _stamp(A.ticker(articles(spark, sf)), "published_at")


def q_article_feed_after(spark, sf):
    """The second page by the last row of the first one."""
    table = articles(spark, sf)
    last = A.article_feed_after(table).collect()[-1]
    return _view(A.article_feed_after(table, (last["published_at"], last["hash_id"])))


# ---------------------------------------------------------- table maintenance
def q_upsert_articles(spark, sf):
    out = M.upsert_articles(stored(spark, sf), incoming(spark, sf), NOW)
    return _stamp(out, "created_at", "updated_at", "generated_at").select(
        "hash_id", "url", "title", "source_name", "category", "generated_at", "created_at", "updated_at"
    )


def q_upsert_stats(spark, sf):
    return M.upsert_stats(stored(spark, sf), incoming(spark, sf))


def q_prune_newest(spark, sf):
    return M.prune_newest(articles(spark, sf)).select("id")


def q_prune_newest_many(spark, sf):
    """Retention of more rows than one task's heap should hold."""
    orders = V.table(spark, sf, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    return M.prune_newest(orders, 12_000, "at").select("o_orderkey")


def q_prune_report(spark, sf):
    return _stamp(M.prune_report(articles(spark, sf)), "cutoff")


def q_log_runs(spark, sf):
    """Runs written to the log, one entry per source, and read back."""
    folder = fresh_path(spark, "runs")
    V.runs_from_events(spark, sf).write.mode("overwrite").parquet(f"{folder}/run_id=0")
    log = M.read_log(spark, folder)
    return log.groupBy("source_name", "status").agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("duration_seconds").alias("seconds"),
        F.sum("articles_added").alias("articles_added"),
    )


def q_write_raw(spark, sf):
    """Raw feeds dumped as JSON, one folder per source, and read back."""
    folder = M.write_raw(raw(spark, sf), fresh_path(spark, "dump"), NOW)
    return spark.read.json(folder).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_articles"), F.min(ORD).alias("first_doc"))


# ------------------------------------------------------- runs, streams, health
def q_run_feeds(spark, sf):
    """Two feeds ingested into a new table, then the second one again."""
    folder = fresh_path(spark, "table")
    table = M.init_tables(spark, folder).articles
    pages = V.articles_from_pages(spark, sf).withColumn("metadata", F.parse_json(F.lit("{}")))
    docs = raw(spark, sf)
    feeds_ = {"documents": docs, "pages": pages}
    results = run_all(feeds_, table, max_articles=None, now=NOW)
    results += run_all({"pages": pages}, table, max_articles=None, now=NOW)
    rows = [
        (i, r["source"], r["scraped"], r["added"], r["updated"], r["skipped"], r["errors"])
        for i, r in enumerate(results)
    ]
    runs = spark.createDataFrame(
        rows, "run int, source string, scraped bigint, added bigint, updated bigint, "
              "skipped bigint, errors bigint",
    )
    stored_rows = table.read().agg(F.count(F.lit(1))).scalar()
    return runs.withColumn("stored", stored_rows)


def q_run_feeds_retained(spark, sf):
    """The same feeds with retention: after each run the newest 100 stay."""
    table = M.init_tables(spark, fresh_path(spark, "table")).articles
    pages = V.articles_from_pages(spark, sf).withColumn("metadata", F.parse_json(F.lit("{}")))
    rows = []
    for i, (name, feed) in enumerate((("documents", raw(spark, sf)), ("pages", pages))):
        run_all({name: feed}, table, max_articles=100, now=NOW + dt.timedelta(hours=i))
        rows.append((i, name, table.read().count()))
    return spark.createDataFrame(rows, "run int, source string, stored bigint")


def q_interleave_sources(spark, sf):
    return interleave_sources(V.documents(spark, sf), source="source", key="doc_id").select(
        "turn", "source", "doc_id"
    )


def q_run_status(spark, sf):
    return _stamp(
        run_status(V.runs_from_events(spark, sf)), "started_at", "last_tick_at", "last_scrape_at"
    )


def q_source_health(spark, sf):
    waiting = V.table(spark, sf, "events").where(F.col("event_type") == "click").select(
        F.concat(F.lit("source"), (F.col("user_id") % 7).cast("string")).alias("source_name")
    ).where(F.col("source_name") != "source2")
    return _joined(source_health(V.runs_from_events(spark, sf), waiting), "issues")


def q_stream_ingest(spark, sf):
    """Stories written as files, ingested as a stream, read from the table."""
    folder = fresh_path(spark, "stream")
    items = story_payloads(spark, sf).select(F.from_json("payload", STORY).alias("i")).select("i.*")
    items.write.json(f"{folder}/in")
    table = M.init_tables(spark, f"{folder}/table").articles
    query = stream_ingest(
        spark, f"{folder}/in", table, f"{folder}/check", f"{folder}/log", max_files=10_000,
        max_articles=None,
    )
    query.awaitTermination()
    return table.read().select("hash_id", "url", "title", "category", "source_name")


def q_stream_dedup(spark, sf):
    """Events as article sightings, deduplicated by the bounded-state operator."""
    seen = V.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("https://example.com/"), F.col("user_id").cast("string")).alias("url"),
    )
    folder = fresh_path(spark, "sightings")
    seen.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(seen.schema).parquet(f"{folder}/in")
    query = (
        stream_dedup(stream, "ts", "3650 days").writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/check").trigger(availableNow=True)
        .start(f"{folder}/out")
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("url")


def _tick_files(spark, seen, folder):
    """The rows of each tick as equally many files, written by as many tasks, one tick after the other; that
    number.  The table is read once."""
    seen.write.partitionBy("tick").parquet(f"{folder}/all")
    ticks, files = spark.read.schema(seen.schema).parquet(f"{folder}/all"), spark.sparkContext.defaultParallelism
    for tick in range(10):
        rows = ticks.where(F.col("tick") == tick).drop("tick")
        rows.repartition(files).write.mode("append").parquet(f"{folder}/in")
        written = len(spark.read.schema(rows.schema).parquet(f"{folder}/in").inputFiles())
        for _ in range((tick + 1) * files - written):  # a task without rows writes no file
            rows.limit(0).write.mode("append").parquet(f"{folder}/in")
    return files


def q_stream_unique(spark, sf):
    """Sightings in ten ticks of three days: every seventh comes a tick late, some of the first tick come
    too late; an article passes again after five days."""
    day = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / (3 * 86400))
    seen = V.table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("https://example.com/"), F.col("user_id").cast("string")).alias("url"),
        F.when((day == 0) & (F.col("event_id") % 13 == 0), 8)
        .when(F.col("event_id") % 7 == 0, F.least(day + 1, F.lit(9))).otherwise(day).alias("tick"))
    folder = fresh_path(spark, "ticks")
    files = _tick_files(spark, seen, folder)
    stream = spark.readStream.schema(seen.drop("tick").schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    query = (
        stream_unique(stream, "ts", "5 days", "7 days").writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start(f"{folder}/out")
    )
    query.awaitTermination()
    return spark.read.schema(seen.drop("tick").schema).parquet(f"{folder}/out").select("event_id", "url")


def _line_files(spark, sf, folder):
    """Story lines, every tenth cut off in the middle, as files written by the scan's tasks, in two lots; the
    number of files that make two ticks."""
    line = F.when(F.col(ORD) % 10 == 3, F.concat(F.lit('{"type": "story", "id": '), F.col(ORD).cast("string"), F.lit(', "title": ')))
    lines = story_payloads(spark, sf).select(F.coalesce(line, F.col("payload")).alias("value"))
    for lot in (0, 1):
        lines.where(F.pmod(F.xxhash64("value"), F.lit(2)) == lot).write.mode("append").text(folder)
    return -(-len(spark.read.text(folder).inputFiles()) // 2)


def q_stream_quarantine(spark, sf):
    """Story lines, every tenth cut off in the middle, ingested in several ticks: what the quarantine holds."""
    folder = fresh_path(spark, "lines")
    half = _line_files(spark, sf, f"{folder}/in")
    table = M.init_tables(spark, f"{folder}/table").articles
    stream_ingest(
        spark, f"{folder}/in", table, f"{folder}/check", f"{folder}/log", max_files=half, quarantine=f"{folder}/bad",
    ).awaitTermination()
    return read_quarantine(spark, f"{folder}/bad")


def q_stream_status(spark, sf):
    """Events in four ticks; the run log comes from the stream's own events."""
    folder = fresh_path(spark, "status")
    seen = V.table(spark, sf, "events").select("event_id", "event_type")
    for tick in range(4):
        seen.where(F.col("event_id") % 4 == tick).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    log = RunLog(spark, f"{folder}/log", "events", f"status-{folder}")
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        counted = stream.observe(METRICS, F.count_if(F.col("event_type") == "purchase").alias("added"))
        query = counted.writeStream.queryName(log.name).format("noop").option(
            "checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        log.ended.wait(120)  # events come a little later than the end itself
    finally:
        spark.streams.removeListener(log)
    return run_status(M.read_log(spark, f"{folder}/log")).select(
        "articles_generated", "scrapes_completed", "scrapes_failed", "running")


# ------------------------------------------------------- queries in SQL alone
def q_sql_url_functions(spark, sf):
    register_functions(spark)
    return spark.sql("""
        SELECT url_key(url) AS url_key, count(*) AS pages, min(hash_id(url)) AS hash_id,
          count_if(is_http_url(url)) AS http_pages
        FROM {pages} GROUP BY url_key(url)""", pages=V.pages(spark, sf))


def q_sql_title_words(spark, sf):
    register_functions(spark)
    return spark.sql("""
        SELECT d.doc_id, title_key(d.title) AS title_key, w.pos, w.word
        FROM (SELECT doc_id, regexp_extract(text, r'^([^.\n]*)', 1) AS title FROM {docs}) d,
          LATERAL title_words(d.title) w""", docs=V.documents(spark, sf))


# ---------------------------------------------------------------- presentation
def q_excerpts(spark, sf):
    return V.documents(spark, sf).select(
        "doc_id", F.md5(T.excerpt_words(F.col("text"), 100)).alias("excerpt_md5")
    )


def q_paragraphs(spark, sf):
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(
        F.replace("text", F.lit("\n"), F.lit(" "))
    )
    found = V.documents(spark, sf).select("doc_id", T.paragraphs(text).alias("p"))
    return found.select("doc_id", F.posexplode("p").alias("pos", "paragraph")).select(
        "doc_id", "pos", F.md5("paragraph").alias("paragraph_md5")
    )


def q_bylines(spark, sf):
    return A.present(raw(spark, sf)).select(
        F.col(ORD).alias("doc_id"), "byline", "initials", F.length("body").alias("body_chars")
    )


QUERIES = {
    name.removeprefix("q_"): fn for name, fn in list(globals().items()) if name.startswith("q_")
}
