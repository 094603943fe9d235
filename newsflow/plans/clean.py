"""The whole cleaning job as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from newsflow.operators import cleaning as C
from newsflow.operators.enrich import enrich


def clean_articles(
    df: DataFrame, ai: bool = True, apply_offset: bool = False, **options
) -> DataFrame:
    """Raw articles to clean, deduplicated, enriched ones.

    Which articles survive is decided on keys alone; the articles themselves
    are then filtered by one semi join on ``_ord``, and only survivors are
    normalised and analysed.  The outcome equals running the steps one by one:
    URL dedup, required fields, defaults, dates, texts, URL check, category,
    tags, title dedup, derived fields, analytics.
    """
    kept = df.join(C.surviving_ords(df), C.ORD, "left_semi")
    out = (
        kept.transform(C.fill_defaults)
        .transform(C.standardize_dates, apply_offset)
        .transform(C.normalize_texts)
        .transform(C.standardize_category)
        .transform(C.clean_tags)
        .transform(C.derive_fields)
    )
    return out.transform(enrich, **options) if ai else out


def clean_step_by_step(df: DataFrame, apply_offset: bool = False) -> DataFrame:
    """The same steps in their literal order, for comparison in tests."""
    return (
        df.transform(C.url_dedup)
        .transform(C.drop_missing_required)
        .transform(C.fill_defaults)
        .transform(C.standardize_dates, apply_offset)
        .transform(C.normalize_texts)
        .transform(C.validate_urls)
        .transform(C.standardize_category)
        .transform(C.clean_tags)
        .transform(C.title_dedup)
        .transform(C.derive_fields)
    )
