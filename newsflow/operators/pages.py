"""Page extraction: metadata and main text of stored web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.arrays import bind
from newsflow.functions.text import BLANK_RUN, decode_references, drop_between, strip
from newsflow.functions.urls import url_host

# --- fixed values: markup that carries no body text, body containers ----------
BOILERPLATE = ("script", "style", "nav", "header", "footer", "aside")
ADVERTISEMENT = r"(?i)<div class=\"ad\""
CONTAINERS = ("article", "main", "body")
BLOCK_TAG = r"(?i)</?(?:p|br|h[1-6]|div|li|ul|ol|tr|table|blockquote|pre|section)\b[^<>]*+>"
ANY_TAG = r"<[^<>]*+>"


def _meta_content(tags: Column, attribute: str, value: str) -> Column:
    """``content`` of the first meta element with the attribute's value before
    or, if there is none, behind its content; the last content of such an element
    counts.  ``tags``: what follows each ``<meta``.

    Linear: every pattern begins at a tag and looks once for the attribute and
    once, from the tag's end, for the content, without trying other attributes.
    """
    wanted = rf"\b{attribute}=[\"']{value.replace('.', chr(92) + '.')}[\"']"
    content = r"\bcontent=[\"']([^\"']*)[\"']"
    behind = rf"(?is)\A(?>[^<>]*?{wanted})[^<>]*{content}"
    # the last content, or the last one that has the attribute somewhere behind it
    last = rf"(?is)\A(?>[^<>]*{content})[^<>]*{wanted}"
    upto = rf"(?is)\A[^<>]*{wanted}"
    inner = rf"(?is)\A[^<>]*{content}"

    def first(own: Column, read) -> Column:
        # later tags aren't looked at when one has matched
        found = F.aggregate(own, F.lit(None).cast("string"), lambda x, tag: F.coalesce(x, read(tag)))
        return F.nullif(found, F.lit(""))

    def taken(text: Column, pattern: str) -> Column:
        return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))

    def before(tag: Column) -> Column:
        return F.coalesce(taken(tag, last), bind(F.regexp_extract(tag, upto, 0), lambda head: taken(head, inner)))

    def either(own: Column) -> Column:
        return F.coalesce(first(own, lambda tag: taken(tag, behind)), first(own, before))

    named = F.lit(f"(?i){value}")
    return bind(
        F.filter(tags, lambda tag: F.contains(F.lower(tag), F.lit("content=")) & F.rlike(tag, named)), either)


def image_url(html: Column) -> Column:
    """Open Graph image, else the card image, else null."""
    tags = F.slice(F.split(html, r"(?i)<meta\b"), 2, 1 << 30)
    return decode_references(
        bind(tags, lambda own: F.coalesce(
            _meta_content(own, "property", "og:image"),
            _meta_content(own, "name", "twitter:image"),
        ))
    )


def element_text(html: Column, tag: str, last: bool = False) -> Column:
    """Content of the first ``tag`` element, up to the next closing tag or, with
    ``last``, up to the last one; null without.  Linear: the text is cut at the
    first opener, and at the closer from the side it is looked for."""
    after = F.get(F.split(html, rf"(?i)<{tag}\b[^<>]*+>", 2), F.lit(1))
    if not last:
        return bind(
            F.split(after, rf"(?i)</{tag}>", 2), lambda cut: F.when(F.size(cut) > 1, cut[0])
        )
    closer = "".join(reversed(f"</{tag}>"))
    return F.reverse(F.get(F.split(F.reverse(after), f"(?i){closer}", 2), F.lit(1)))


def page_title(html: Column) -> Column:
    return strip(decode_references(F.coalesce(element_text(html, "title"), F.lit(""))))


def page_metadata(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Adds ``image_url``, ``page_title``, ``page_lang`` and ``page_host``."""
    return pages.withColumns(
        {
            "image_url": image_url(F.col(html)),
            "page_title": page_title(F.col(html)),
            "page_lang": F.nullif(
                F.regexp_extract(html, r"(?is)<html\b[^<>]*\blang=[\"']([^\"']*)[\"']", 1), F.lit("")
            ),
            "page_host": url_host(F.col(url)),
        }
    )


def _without(page: Column, opener: str, closer: str, stray: str) -> Column:
    return bind(page, lambda p: drop_between(p, opener, closer, " ", stray))


def main_text(html: Column) -> Column:
    """Body text of a page: boilerplate out, the first of ``<article>``,
    ``<main>``, ``<body>``, block tags to line breaks, the rest stripped.

    The rule is this engine's own.  Nested advertisement boxes end at their
    first closing tag.
    """

    def cleared(page: Column) -> Column:
        for tag in BOILERPLATE:
            page = _without(page, rf"(?i)<{tag}\b", f"(?i)</{tag}>", f"</{tag}>")
        return _without(page, ADVERTISEMENT, "(?i)</div>", "</div>")

    body = drop_between(F.coalesce(html, F.lit("")), "<!--", "-->", " ", "-->")
    body = bind(body, lambda page: F.when(F.contains(page, F.lit("</")), cleared(page)).otherwise(page))

    def container(page: Column) -> Column:
        found = [F.nullif(element_text(page, tag, last=True), F.lit("")) for tag in CONTAINERS]
        return F.coalesce(*found, page)

    text = F.regexp_replace(bind(body, container), BLOCK_TAG, "\n")
    text = decode_references(F.regexp_replace(text, ANY_TAG, ""))
    text = F.regexp_replace(text, BLANK_RUN, " ")
    lines = F.transform(F.split(text, "\n"), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def page_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.withColumn("page_text", main_text(F.col(html)))
