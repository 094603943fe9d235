"""The column functions as SQL functions, for queries written in SQL alone.

Their bodies are SQL expressions that Spark inlines, so they run inside the
generated code like the column functions, and the same patterns serve both.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from newsflow import rules as R
from newsflow.functions.arrays import quoted
from newsflow.functions.text import WORD
from newsflow.functions.urls import HTTP_URL, URL_PARTS

LONG_WORD = 3  # characters that a word of a title key has more than
KEY_WORDS = 5

_TRIMMED = rf"regexp_replace(url, {quoted(r'\A[\x00-\x20]+|[\t\r\n]')}, '')"
_MARKED = f"regexp_replace({_TRIMMED}, {quoted(URL_PARTS)}, {quoted('$1://$2' + chr(10) + '$3')})"
_LONG_WORDS = (
    f"slice(filter(regexp_extract_all(lower(coalesce(title, '')), {quoted(WORD)}, 0), "
    f"w -> length(w) > {LONG_WORD}), 1, {KEY_WORDS})"
)

# name, arguments, result, body
FUNCTIONS = (
    ("url_key", "url STRING", "STRING",
     f"CASE WHEN coalesce(url, '') = '' THEN '' ELSE "
     f"lower(replace(regexp_replace({_MARKED}, {quoted(r'/+\z')}, ''), {quoted(chr(10))}, '')) END"),
    ("is_http_url", "url STRING", "BOOLEAN", f"coalesce(rlike({_TRIMMED}, {quoted(HTTP_URL)}), false)"),
    ("hash_id", "url STRING", "STRING", f"substring(sha2(url, 256), 1, {R.HASH_ID_CHARS})"),
    ("title_key", "title STRING", "STRING", f"array_join(array_sort({_LONG_WORDS}), ' ')"),
    ("title_case", "title STRING", "STRING",
     f"array_join(transform(regexp_extract_all(lower(title), {quoted(r'[\p{L}]+|[^\p{L}]+')}, 0), "
     "r -> concat(upper(substring(r, 1, 1)), substring(r, 2))), '')"),
    # a table function, for LATERAL
    ("title_words", "title STRING", "TABLE(pos INT, word STRING)",
     f"SELECT pos, word FROM (SELECT {_LONG_WORDS} AS list) LATERAL VIEW posexplode(list) AS pos, word"),
)


def register_functions(spark: SparkSession) -> list[str]:
    """Make all functions known to the session under their names, which it returns.

    ``title_words(title)`` is a table function: the words of the title's key in
    reading order, none for a title without long words.
    """
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return [name for name, *_ in FUNCTIONS]
