"""Text column functions: whitespace, words, entities, markup, title keys.

All of them are row-local native expressions: no Python workers, no shuffle.
Character classes are spelled out because Java's ``\\w``/``\\s`` are ASCII.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow.functions.arrays import bind, bind_sql, empty_strings, rows, string_map

# --- fixed values: character classes and patterns -----------------------------
SPACE = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = "".join(chr(n) for n in range(0x3001) if chr(n).isspace())  # the same, listed
WORD_CHAR = r"[\p{L}\p{N}_]"
WORD = WORD_CHAR + "+"
BLANK_RUN = r"[ \t]{2,}|\t"
CONTROL = r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x9f]"
# an HTML character reference, or the text around it
REFERENCE_OR_TEXT = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
# elements whose text is not part of the visible text
HIDDEN = ("script", "style", "template", "rt", "rp")
# A tag ends before the next "<" outside quotes, so no pattern looks further
# than that, and all repetitions are possessive: Java neither recurses nor goes
# back.
TAG = (
    r"(?:</?[A-Za-z][^<>'\"]*+(?:(?:\"[^\"]*+\"|'[^']*+')[^<>'\"]*+)*+>"
    r"|</?[A-Za-z][^<>]*+>|<[!?][^<>]*+>)"
)
MARK = "\uffff"  # no character of any text: stands for removed markup

# Names that are references even without the closing semicolon.
_OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
# References by name, and by number the code points with a meaning of their own:
# 0x80-0x9f are read as Windows-1252.
_REFERENCES = (
    html5
    | {f"#{n}": bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
    | {"#0": "\ufffd", "#13": "\r"}
)


def is_blank(c: Column) -> Column:
    """True for null, empty and whitespace-only strings."""
    return F.coalesce(F.rlike(c, F.lit(rf"\A{SPACE}*\z")), F.lit(True))


def strip(c: Column) -> Column:
    """Cut Unicode whitespace at both ends (``trim`` cuts spaces only)."""
    return F.btrim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    """Lower-cased Unicode words in reading order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def default_if_blank(c: Column, default: str) -> Column:
    return F.when(is_blank(c), F.lit(default)).otherwise(c)


def default_if_empty(c: Column, default: str) -> Column:
    """Null or exactly ``""`` becomes the default; blanks stay."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def first_matching(text: Column, rules, otherwise: Column) -> Column:
    """Name of the first rule with a substring of ``text``, in rule order."""
    table = rows([{"name": n, "needles": list(k)} for n, k in rules],
                 "name string, needles array<string>")

    def hits(t: Column) -> Column:
        return F.filter(
            table, lambda r: F.exists(r["needles"], lambda needle: F.contains(t, needle))
        )

    return F.coalesce(F.get(bind(text, hits), F.lit(0))["name"], otherwise)


# ---------------------------------------------------------------- references
# Value of a numeric reference p; more digits than these lie past the last code
# point anyway, as does 0x110000.
_NUMBER = r"""
coalesce(try_cast(
  CASE WHEN rlike(p, r'\A&#[xX]') THEN
    CASE WHEN length(regexp_replace(p, r'\A&#[xX]0*|;\z', '')) <= 8
         THEN conv(concat('0', regexp_replace(p, r'\A&#[xX]|;\z', '')), 16, 10) END
  WHEN length(regexp_replace(p, r'\A&#0*|;\z', '')) <= 9
  THEN regexp_replace(p, r'\A&#|;\z', '') END AS bigint), 1114112)
"""
_CHARACTER = """
CASE WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN '\ufffd'
     WHEN n < 32 AND n NOT IN (9, 10, 12, 13) OR n = 127
          OR n BETWEEN 64976 AND 65007 OR n & 65534 = 65534 THEN ''
     ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END
"""
# A name that is no reference as a whole: its longest historic prefix, or the
# name with the semicolon it lacks.
_PREFIX = rf"""
transform(array(regexp_extract(p, r'\A&({"|".join(_OPEN_NAMES)})', 1)),
          o -> concat(try_element_at(x.names, o), substring(p, length(o) + 2)))[0]
"""
_CLOSED = "try_element_at(x.names, concat(substring(p, 2), ';'))"


def decode_references(c: Column, loose: bool = True) -> Column:
    """Decode HTML character references, named and numeric.

    ``loose`` also accepts the historic names without semicolon as a prefix
    (``&copy2024``), as browsers do.  Text without ``&`` is left alone.
    """
    decoded = f"""
    CASE WHEN contains(x.s, '&') THEN array_join(
      transform(regexp_extract_all(x.s, r'{REFERENCE_OR_TEXT}', 0), p ->
        CASE WHEN NOT startswith(p, '&') OR length(p) = 1 THEN p
             WHEN p = '&amp;' THEN '&' WHEN p = '&lt;' THEN '<'
             WHEN p = '&gt;' THEN '>' WHEN p = '&quot;' THEN '"'
             WHEN startswith(p, '&#') THEN transform(array({_NUMBER}),
               n -> coalesce(try_element_at(x.names, concat('#', n)), {_CHARACTER}))[0]
             ELSE coalesce(try_element_at(x.names, substring(p, 2)),
                           {_PREFIX if loose else _CLOSED}, p) END), '')
    ELSE x.s END
    """
    return bind_sql(F.struct(c.alias("s"), string_map(_REFERENCES).alias("names")), decoded)


# -------------------------------------------------------------------- markup
def drop_between(text: Column, opener: str, closer: str, instead: str, stray: str = "") -> Column:
    """Replace everything from an opener to the next closer.

    The text is cut at its closers; of each piece but the last, what follows the
    first opener goes.  Every character is looked at a fixed number of times,
    also when openers or closers come by the thousand and have no partner.  An
    opener that is never closed stays; a closer without opener becomes ``stray``.
    """

    def kept(pieces: Column) -> Column:
        last = F.size(pieces) - 1

        def one(piece: Column, i: Column) -> Column:
            return bind(
                F.split(piece, opener, 2),
                lambda cut: F.when(i == last, piece)
                .when(F.size(cut) > 1, F.concat(cut[0], F.lit(instead)))
                .otherwise(F.concat(piece, F.lit(stray))),
            )

        return F.array_join(F.transform(pieces, one), "")

    return F.when(F.rlike(text, F.lit(closer)), bind(F.split(text, closer, -1), kept)).otherwise(text)


def drop_hidden(text: Column, instead: str = MARK) -> Column:
    """Comments and elements without visible text, one kind after the other."""

    def elements(rest: Column) -> Column:
        for name in HIDDEN:
            rest = _drop_element(rest, name, instead)
        return rest

    text = F.when(F.contains(text, F.lit("-->")), drop_between(text, "<!--", "-->", instead, "-->")).otherwise(text)
    # most texts close none of these elements: one search says so for all of them
    closer = F.lit(rf"(?i)</(?:{'|'.join(HIDDEN)})\s*+>")
    return bind(text, lambda t: F.when(
        F.contains(t, F.lit("</")) & F.rlike(t, closer), elements(t)).otherwise(t))


def _drop_element(text: Column, name: str, instead: str) -> Column:
    return bind(
        text, lambda t: drop_between(t, rf"(?i)<{name}\b", rf"(?i)</{name}\s*+>", instead, f"</{name}>")
    )


def strip_tags(c: Column, joiner: str = "\n") -> Column:
    """Drop markup and hidden elements; ``joiner`` stands between text nodes.

    Every tag becomes one mark and runs of marks one joiner: a run of single
    characters is matched by a loop, a run of tags would be by recursion.
    """

    def stripped(text: Column) -> Column:
        marked = F.regexp_replace(drop_hidden(text), TAG, MARK)
        return F.when(
            F.contains(text, F.lit("<")), F.regexp_replace(marked, MARK + "+", joiner)
        ).otherwise(text)

    return bind(c, stripped)


def normalize_text(c: Column) -> Column:
    """References decoded, markup out, blanks collapsed, controls deleted.

    References are decoded before the markup goes, so escaped tags vanish too,
    and once more after it, because the text of a parsed page is decoded again.
    """
    plain = strip_tags(decode_references(F.coalesce(c, F.lit(""))))
    plain = decode_references(plain, loose=False)
    plain = F.regexp_replace(plain, BLANK_RUN, " ")
    plain = F.regexp_replace(plain, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(plain, CONTROL, ""))


def joined_text(c: Column) -> Column:
    """Visible text of an HTML fragment, each text node stripped, no joiner."""
    c = F.coalesce(c, F.lit(""))
    nodes = F.transform(F.split(F.regexp_replace(drop_hidden(c), TAG, MARK), MARK), strip)
    return strip(decode_references(F.array_join(nodes, "")))


# --------------------------------------------------------------- normal forms
def title_case(c: Column) -> Column:
    """Upper-case the first letter of every letter run, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}]+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30)),
        ),
        "",
    )


def title_key(c: Column) -> Column:
    """First five words longer than three characters, sorted."""
    long_words = F.filter(words(F.coalesce(c, F.lit(""))), lambda w: F.length(w) > 3)
    return F.array_join(F.sort_array(F.slice(long_words, 1, 5)), " ")


def clean_tag_list(tags: Column, limit: int) -> Column:
    """Strip, lower, delete punctuation, drop short ones, keep the first of each."""
    cleaned = F.transform(
        F.coalesce(tags, empty_strings()),
        lambda t: F.regexp_replace(
            F.lower(strip(t)), rf"[^\p{{L}}\p{{N}}_\-{SPACE[1:-1]}]", ""
        ),
    )
    return F.slice(
        F.array_distinct(F.filter(cleaned, lambda t: F.length(t) > 1)), 1, limit
    )


def compact_count(c: Column) -> Column:
    """``"1,234"`` -> 1234, ``"1.2k"`` -> 1200, anything else -> 0."""

    def number(text: Column) -> Column:
        thousands = F.regexp_replace(text, "k", "").try_cast("double") * 1000
        return F.when(F.contains(text, F.lit("k")), thousands.try_cast("bigint")).when(
            F.rlike(text, F.lit(r"\A[+-]?[0-9]+\z")), text.try_cast("bigint")
        )

    plain = F.lower(F.regexp_replace(strip(c), ",", ""))
    return F.coalesce(bind(plain, number), F.lit(0).cast("bigint"))


# --------------------------------------------------------------- presentation
def excerpt_words(c: Column, n: int = 100) -> Column:
    """At most ``n`` words; a longer text is cut and closed with ``...``."""
    return bind(
        F.split(F.coalesce(c, F.lit("")), SPACE + "+"),
        lambda w: F.when(F.size(w) <= n, F.coalesce(c, F.lit(""))).otherwise(
            F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("..."))
        ),
    )


def paragraphs(c: Column, group: int = 4) -> Column:
    """Split a text into paragraphs: as marked up, by blank lines, or by
    ``group`` sentences."""
    text = F.coalesce(c, F.lit(""))

    def non_blank(parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: ~is_blank(p)), strip)

    def by_sentence(s: Column) -> Column:
        return F.when(F.size(s) < group, F.array(text)).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size(s) - 1) / group).cast("int")),
                lambda g: strip(
                    F.array_join(F.transform(F.slice(s, g * group + 1, group), strip), " ")
                ),
            )
        )

    # the text after the last mark is matched too, so that it is read only once,
    # and dropped
    sentences = F.filter(
        F.regexp_extract_all(text, F.lit(r"[^.!?]++[.!?]*+"), F.lit(0)),
        lambda s: F.rlike(s, F.lit(r"[.!?]\z")),
    )
    return (
        F.when(text == "", empty_strings())
        .when(F.contains(text, F.lit("<p>")) | F.contains(text, F.lit("<br")), F.array(text))
        .when(F.contains(text, F.lit("\\n\\n")), non_blank(F.split(text, r"\\n\\n")))
        .when(F.contains(text, F.lit("\n\n")), non_blank(F.split(text, "\n\n")))
        .otherwise(bind(sentences, by_sentence))
    )
