"""Date column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow.functions.arrays import bind
from newsflow.functions.text import SPACE, strip

# --- fixed values: accepted layouts, tried in this order ----------------------
DATE_FORMATS = (
    "yyyy-M-d H:m:s",
    "yyyy-M-d",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "d MMMM yyyy",
    "d MMM yyyy",
)
RSS_FORMAT = "d MMM yyyy H:m:s"
INGEST_ISO_FORMATS = ("yyyy-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]'Z'",
                      "yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d'T'H:m:s")
WEEKDAY = r"^(?i:Mon|Tue|Wed|Thu|Fri|Sat|Sun), "
ISO_PREFIX = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
ISO_TEXT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _first_format(text: Column, formats) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def _one_blank(text: Column) -> Column:
    return F.regexp_replace(strip(text), SPACE + "+", " ")


def _weekday_date(t: Column) -> Column:
    """A full feed date; a weekday is accepted in this layout only."""
    return F.when(
        F.rlike(t, F.lit(WEEKDAY)),
        F.try_to_timestamp(F.regexp_replace(t, WEEKDAY, ""), F.lit(RSS_FORMAT)),
    )


def _loose_date(text: Column) -> Column:
    """First layout that fits the whole text."""
    return bind(
        _one_blank(text),
        lambda t: F.coalesce(_first_format(t, DATE_FORMATS), _weekday_date(t)),
    )


def article_date_text(c: Column) -> Column:
    """ISO text of an article date, null if no layout fits.

    A text that starts like an ISO date-time is kept: unless it ends in ``Z``
    it is cut at the first ``+`` and closed with ``Z`` -- a positive offset is
    dropped, not applied.
    """

    def iso(t: Column) -> Column:
        kept = F.when(F.endswith(t, F.lit("Z")), t).otherwise(
            F.concat(F.substring_index(t, "+", 1), F.lit("Z"))
        )
        return F.when(F.rlike(t, F.lit(ISO_PREFIX)), kept).otherwise(
            F.date_format(_loose_date(t), ISO_TEXT)
        )

    return bind(strip(c), iso)


def stored_timestamp(iso_text: Column) -> Column:
    """Timestamp of an ISO text, null on failure.  ``Z`` and ``+00:00`` are
    dropped wherever they stand, as is the pair ``+00:00Z``."""
    bare = F.replace(
        F.replace(iso_text, F.lit("Z"), F.lit("+00:00")), F.lit("+00:00"), F.lit("")
    )
    return bare.try_cast("timestamp")


def article_date(c: Column, apply_offset: bool = False) -> Column:
    """Article date as timestamp.  ``apply_offset=True`` honours the zone
    offset of an ISO text instead of dropping it."""
    parity = stored_timestamp(article_date_text(c))
    if not apply_offset:
        return parity
    t = strip(c)
    return F.when(
        F.rlike(t, F.lit(ISO_PREFIX)),
        F.regexp_replace(t, r"([+-][0-9]{2}:[0-9]{2})Z$", "$1").try_cast("timestamp"),
    ).otherwise(parity)


def ingest_date_text(c: Column) -> Column:
    """Dates as accepted at ingest: ISO texts in full, or a plain layout."""

    def text(parsed: Column) -> Column:
        has_micros = F.date_format(parsed, "SSSSSS") != "000000"
        return F.when(
            has_micros, F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        ).otherwise(F.date_format(parsed, ISO_TEXT))

    formats = INGEST_ISO_FORMATS + DATE_FORMATS
    return bind(bind(_one_blank(c), lambda t: _first_format(t, formats)), text)


def feed_date_text(c: Column) -> Column:
    """Feed item date: the last word (the zone) is cut, not converted."""
    cut = _one_blank(F.regexp_replace(strip(c), " [^ ]*$", ""))
    return F.coalesce(
        F.date_format(bind(cut, _weekday_date), ISO_TEXT), ingest_date_text(c)
    )
