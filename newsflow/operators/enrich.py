"""Rule-based text analytics: category, keywords, entities, sentiment.

Every function maps one row to one row.  Scores are computed with array
functions inside the row, so a corpus of any size is enriched in the scan stage
without a shuffle, and a document never meets the rows of another one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow import rules as R
from newsflow.functions.arrays import bind_sql, empty_strings, let, quoted, rows, strings
from newsflow.functions.text import WORD, WORD_CHAR

# --- fixed values: run and amount patterns ------------------------------------
# equal words of a sorted list that is joined by blanks
RUN = r"([a-z0-9]++)(?: \1(?![a-z0-9]))*+"
AMOUNT = (
    r"\$[\p{Nd},]+(?:\.\p{Nd}+)?"
    r"(?:[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
    r"(?:million|billion|M|B|m|b))?"
)
LOW_CONFIDENCE = 0.1
HIGH_CONFIDENCE = 0.5


def categorize(
    title: Column,
    content: Column,
    current: Column | None = None,
    rules: Iterable[R.Category] = R.CATEGORY_RULES,
) -> Column:
    """``struct<category, confidence>`` by weighted keyword counts.

    Keywords in the title count double, the earlier category wins a tie, and
    the confidence is the score over three times the number of keywords.  The
    points are added in rule order, so equal texts give equal bits anywhere.
    """
    rules = list(rules)
    table = rows(
        [
            {"cat": i, "kw": kw, "n": len(kw), "w": c.weight}
            for i, c in enumerate(rules)
            for kw in c.keywords
        ],
        "cat int, kw string, n int, w double",
    )
    categories = rows(
        [
            {"cat": i, "name": c.name, "top": 3 * len(c.keywords)}
            for i, c in enumerate(rules)
        ],
        "cat int, name string, top int",
    )
    own = F.nullif(current, F.lit("")) if current is not None else F.lit(None).cast("string")
    # keywords of the text with their points; occurrences don't overlap, so
    # their number is what their removal saves
    found = """
      transform(filter(x.rules, r -> contains(d.text, r.kw)), r -> named_struct(
        'cat', r.cat,
        'points', cast((d.size - length(replace(d.text, r.kw))) / r.n AS int)
                  * if(contains(d.head, r.kw), 2, 1) * r.w))"""
    best = """
      array_max(transform(x.categories, c -> named_struct(
        'score', aggregate(filter(found, p -> p.cat = c.cat), 0.0D, (sum, p) -> sum + p.points),
        'rank', -c.cat, 'name', c.name, 'top', c.top)))"""
    verdict = f"""
      CASE WHEN b.score > 0 THEN named_struct(
        'category', CASE WHEN b.score / b.top < {LOW_CONFIDENCE}D AND x.own IS NOT NULL
                         THEN x.own ELSE b.name END,
        'confidence', least(b.score / b.top, 1.0D))
      ELSE x.fallback END"""
    document = "named_struct('text', t, 'size', length(t), 'head', lower(x.title))"
    body = let("d", document, let("found", found, let("b", best, verdict)))
    return bind_sql(
        F.struct(
            title.alias("title"),
            F.coalesce(content, F.lit("")).alias("content"),
            own.alias("own"),
            F.struct(
                F.coalesce(own, F.lit(R.DEFAULT_CATEGORY)).alias("category"),
                F.lit(0.0).alias("confidence"),
            ).alias("fallback"),
            table.alias("rules"),
            categories.alias("categories"),
        ),
        "CASE WHEN coalesce(x.title, '') = '' THEN x.fallback ELSE "
        + let("t", "lower(concat(x.title, ' ', x.content))", body)
        + " END",
    )


def keywords(
    text: Column,
    k: int = 10,
    min_length: int = 3,
    stop_words: Iterable[str] = R.STOP_WORDS,
    boosted: Iterable[str] = R.TECH_TERMS,
) -> Column:
    """The ``k`` most frequent words, ties by first appearance; the count of
    boosted terms is doubled."""
    def listed(values: Iterable[str]) -> str:
        return ", ".join(map(quoted, values)) or "''"

    token = rf"(?<!{WORD_CHAR})[a-z][a-z0-9]{{{max(min_length, 1) - 1},}}+(?!{WORD_CHAR})"
    tokens = f"regexp_extract_all(lower(x), r'{token}', 0)"
    # equal words stand together when sorted; a run's length tells their number
    counted = f"""
      filter(transform(
        regexp_extract_all(array_join(sort_array(a), ' '), r'{RUN}', 0),
        run -> transform(array(substring_index(run, ' ', 1)), w -> named_struct(
          'n', ((length(run) + 1) div (length(w) + 1)) * if(w IN ({listed(boosted)}), 2, 1),
          'word', w))[0]), c -> c.word NOT IN ({listed(stop_words)}))"""
    # the k-th largest count, 0 if there are fewer words: less than k are above
    # it, the others that have it go by first appearance
    least = f"coalesce(get(sort_array(c.n, false), {k - 1}), 0)"
    above = "filter(c, y -> y.n > least)"
    top = """
      transform(sort_array(transform(above, y -> named_struct(
        'minus_count', -y.n, 'pos', array_position(a, y.word), 'word', y.word))), y -> y.word)"""
    ties = f"slice(array_intersect(a, filter(c, y -> y.n = least).word), 1, greatest({k} - size(above), 0))"
    ranked = let("above", above, f"slice(concat({top}, {ties}), 1, {k})")
    found = let("a", tokens, let("c", counted, let("least", least, ranked)))
    return bind_sql(F.coalesce(text, F.lit("")), found)


def entities(text: Column, companies: Iterable[str] = R.COMPANIES) -> Column:
    """``struct<companies, technologies, amounts>``: company names as first
    written in the text, in list order; the first five money amounts."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.lower(text)
    found = [
        F.when(
            F.contains(lowered, F.lit(name)),
            F.nullif(F.regexp_extract(text, rf"(?iu)\Q{name}\E", 0), F.lit("")),
        )
        for name in companies
    ]
    return F.struct(
        F.array_compact(F.array(*found)).alias("companies"),
        empty_strings().alias("technologies"),
        F.slice(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)), 1, 5).alias("amounts"),
    )


def sentiment(text: Column, lexicon: R.Lexicon = R.Lexicon()) -> Column:
    """``struct<label, positive, negative, confidence>`` by distinct lexicon
    words; the confidence is the unsigned surplus per distinct word."""

    distinct = f"array_distinct(regexp_extract_all(lower(x.text), r'{WORD}', 0))"
    counts = """named_struct('p', size(array_intersect(w, x.positive)),
                             'n', size(array_intersect(w, x.negative)), 'size', size(w))"""
    labelled = """named_struct(
      'label', CASE WHEN c.p > c.n THEN 'positive' WHEN c.n > c.p THEN 'negative' ELSE 'neutral' END,
      'positive', c.p, 'negative', c.n,
      'confidence', abs(c.p - c.n) / greatest(c.size, 1))"""
    return bind_sql(
        F.struct(
            F.coalesce(text, F.lit("")).alias("text"),
            strings(lexicon.positive).alias("positive"),
            strings(lexicon.negative).alias("negative"),
        ),
        let("w", distinct, let("c", counts, labelled)),
    )


# ------------------------------------------------------------ DataFrame steps
def article_text() -> Column:
    """Title, summary and content of an article, joined by blanks."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "summary", "content")]
    return F.concat_ws(" ", *parts)


def add_category(df: DataFrame, rules: Iterable[R.Category] = R.CATEGORY_RULES) -> DataFrame:
    """``ai_category``/``ai_confidence`` of cleaned articles.  The text that is
    scored repeats the title, so title words weigh more."""
    verdict = categorize(F.col("title"), article_text(), rules=rules)
    return df.withColumn("_verdict", verdict).select(
        *df.columns,
        F.col("_verdict.category").alias("ai_category"),
        F.col("_verdict.confidence").alias("ai_confidence"),
    )


def recategorize(df: DataFrame, rules: Iterable[R.Category] = R.CATEGORY_RULES) -> DataFrame:
    """Overwrite ``category`` from title and body (the summary stands in for an
    empty content); an unsure verdict keeps the present category."""
    body = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("summary"))
    verdict = categorize(F.col("title"), body, current=F.col("category"), rules=rules)
    rest = [c for c in df.columns if c not in ("category", "ai_confidence")]
    return df.withColumn("_verdict", verdict).select(
        *rest,
        F.col("_verdict.category").alias("category"),
        F.bround(F.col("_verdict.confidence"), 3).alias("ai_confidence"),
    )


def add_keywords(df: DataFrame, k: int = 5, **options) -> DataFrame:
    return df.withColumn("ai_keywords", keywords(article_text(), k, **options))


def add_sentiment(df: DataFrame, lexicon: R.Lexicon = R.Lexicon()) -> DataFrame:
    return df.withColumn("_mood", sentiment(article_text(), lexicon)).select(
        *df.columns,
        F.col("_mood.label").alias("sentiment"),
        F.col("_mood.confidence").alias("sentiment_score"),
    )


def enrich(
    df: DataFrame,
    rules: Iterable[R.Category] = R.CATEGORY_RULES,
    lexicon: R.Lexicon = R.Lexicon(),
    **keyword_options,
) -> DataFrame:
    """All analytics columns; a row whose analysis yields nothing falls back to
    its own category, no keywords and a neutral mood."""
    text = article_text()
    own = [F.col("category")] if "category" in df.columns else []
    analysed = df.withColumns(
        {
            "_verdict": categorize(F.col("title"), text, rules=rules),
            "_words": keywords(text, **{"k": 5, **keyword_options}),
            "_mood": sentiment(text, lexicon),
        }
    )
    return analysed.select(
        *df.columns,
        F.coalesce("_verdict.category", *own, F.lit(R.DEFAULT_CATEGORY)).alias("ai_category"),
        F.coalesce("_verdict.confidence", F.lit(0.0)).alias("ai_confidence"),
        F.coalesce("_words", empty_strings()).alias("ai_keywords"),
        F.coalesce("_mood.label", F.lit("neutral")).alias("sentiment"),
        F.coalesce("_mood.confidence", F.lit(0.0)).alias("sentiment_score"),
    )


def confident_count(df: DataFrame) -> DataFrame:
    """Number of articles and of those categorised with high confidence."""
    return df.agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.count_if(F.col("ai_confidence") > HIGH_CONFIDENCE).alias("n_confident"),
    )
