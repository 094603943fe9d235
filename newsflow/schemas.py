"""Canonical schemas as DDL strings."""

CLEAN_ARTICLE = (
    "source_name STRING, title STRING, url STRING, author STRING, published_at TIMESTAMP, "
    "scraped_at TIMESTAMP, content STRING, summary STRING, category STRING, "
    "tags ARRAY<STRING>, hash_id STRING, content_length INT, has_content BOOLEAN, "
    "ai_category STRING, ai_confidence DOUBLE, ai_keywords ARRAY<STRING>, "
    "sentiment STRING, sentiment_score DOUBLE, extra_data VARIANT, _ord BIGINT"
)

# stored article: what the clean article gains in the table
ARTICLE_TABLE = (
    "id BIGINT, " + CLEAN_ARTICLE.removesuffix(", _ord BIGINT")
    + ", source_id INT, generated_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
)

SOURCE = (
    "id INT, name STRING, display_name STRING, url STRING, description STRING, "
    "is_active BOOLEAN, scrape_frequency_hours INT"
)

SCRAPE_LOG = (
    "source_name STRING, started_at TIMESTAMP, completed_at TIMESTAMP, "
    "duration_seconds BIGINT, status STRING, articles_scraped BIGINT, "
    "articles_added BIGINT, articles_updated BIGINT, articles_skipped BIGINT, "
    "articles_pruned BIGINT, error_message STRING"
)

STORY = (
    "id BIGINT, type STRING, title STRING, url STRING, by STRING, time BIGINT, "
    "score BIGINT, descendants BIGINT, text STRING"
)

RSS_ITEM = (
    "title STRING, link STRING, `dc:creator` STRING, creator STRING, "
    "author STRUCT<_VALUE: STRING, name: STRING>, pubDate STRING, description STRING, "
    "`content:encoded` STRING, content STRING, category ARRAY<STRING>, "
    "`media:content` STRUCT<_url: STRING>, `media:thumbnail` STRUCT<_url: STRING>"
)
