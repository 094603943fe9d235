"""URL column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: generic URI split (scheme, authority, path without the
# parameters of its last segment; query and fragment are not captured) --------
URL_PARTS = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?"
    r"((?:[^?#]*/)?[^?#/;]*)(?:;[^?#]*)?(?:[?#].*)?$"
)
HTTP_URL = r"^(?i:https?)://[^/?#]+"


def _trimmed(url: Column) -> Column:
    """URL parsers ignore leading controls and blanks, and any tab or newline."""
    return F.regexp_replace(url, r"\A[\x00-\x20]+|[\t\r\n]", "")


def url_key(url: Column) -> Column:
    """Comparison key of a URL: scheme, authority and path in lower case,
    without trailing slashes, query, fragment and path parameters.
    Null and empty share the key ``""``."""
    # a line break marks the start of the path while its slashes are cut
    marked = F.regexp_replace(_trimmed(url), URL_PARTS, "$1://$2\n$3")
    key = F.lower(F.replace(F.regexp_replace(marked, r"/+\z", ""), F.lit("\n"), F.lit("")))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(key)


def is_http_url(url: Column) -> Column:
    """True for http(s) URLs with a host; never null."""
    return F.coalesce(F.rlike(_trimmed(url), F.lit(HTTP_URL)), F.lit(False))


def url_host(url: Column) -> Column:
    """Authority of the URL in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def hash_id(url: Column, digits: int = 24) -> Column:
    """Leading hex digits of the SHA-256 of the raw URL."""
    return F.substring(F.sha2(url, 256), 1, digits)
