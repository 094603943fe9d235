import random
import re

from pyspark.sql import functions as F

from newsflow import rules as R
from newsflow import views as V
from newsflow.operators import enrich as E
from checks.queries import CORPUS_BOOST, CORPUS_LEXICON, CORPUS_RULES

from helpers import column


def occurrences(text, needle):
    """Non-overlapping occurrences, by position."""
    found, at = 0, text.find(needle)
    while at >= 0:
        found, at = found + 1, text.find(needle, at + len(needle))
    return found


def category_oracle(title, content, rules, current=None):
    own = current or "Tech News"
    body, head = f"{title} {content}".lower(), title.lower()
    best = (0.0, own, 1)
    for rule in rules if title else ():
        points = 0.0
        for kw in rule.keywords:
            points += occurrences(body, kw) * (1 + (kw in head)) * rule.weight
        if points > best[0]:
            best = (points, rule.name, 3 * len(rule.keywords))
    if not best[0]:
        return own, 0.0
    confidence = min(1.0, best[0] / best[2])
    return (current if current and confidence < 0.1 else best[1]), confidence


def keyword_oracle(text, k, boost=R.TECH_TERMS):
    tokens = [w for w in re.findall(r"\w+", text.lower()) if re.fullmatch(r"[a-z][a-z0-9]*", w)]
    tokens = [w for w in tokens if len(w) > 2 and w not in R.STOP_WORDS]
    rank = {w: (-tokens.count(w) * (2 if w in boost else 1), tokens.index(w)) for w in set(tokens)}
    return sorted(rank, key=rank.get)[:k]


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def check_categories(spark, sf_dir, rules, current):
    df = V.articles_from_documents(spark, sf_dir)
    own = F.col("category") if current else None
    verdict = E.categorize(F.col("title"), F.col("content"), own, rules)
    for r in df.select("title", "content", "category", verdict.alias("v")).collect():
        expected = category_oracle(r.title, r.content, rules, r.category if current else None)
        assert (r.v.category, r.v.confidence) == expected


def test_categories_equal_a_row_by_row_oracle(spark, sf_dir):
    check_categories(spark, sf_dir, R.CATEGORY_RULES, False)


def test_categories_with_corpus_rules_and_own_category(spark, sf_dir):
    check_categories(spark, sf_dir, CORPUS_RULES, True)


def test_categories_of_news_titles(spark):
    titles = [
        "OpenAI launches GPT-5 with improved reasoning capabilities", "Stripe raises $600M at $95B valuation",
        "Critical vulnerability found in popular npm package", "React 19 released with new compiler",
        "Introducing introducing", "", "nothing here", "open source game",
    ]
    got = column(spark, titles, lambda c: E.categorize(c, F.lit("")))
    assert [(g.category, g.confidence) for g in got] == [
        category_oracle(t, "", R.CATEGORY_RULES) for t in titles
    ]
    assert got[4].confidence == 12 / 51  # listed twice, two occurrences, both in the title


def test_tie_goes_to_the_earlier_category(spark):
    rules = (R.Category("One", 1.0, ("aa",)), R.Category("Two", 1.0, ("bb",)))
    assert column(spark, ["bb aa"], lambda c: E.categorize(c, F.lit(""), rules=rules))[0].category == "One"


def test_unsure_verdict_keeps_the_own_category(spark):
    got = column(spark, ["a platform"], lambda c: E.categorize(c, F.lit(""), F.lit("Mine")))
    assert got[0].category == "Mine" and 0 < got[0].confidence < 0.1


def test_keywords_equal_a_row_by_row_oracle(spark, sf_dir):
    words = E.keywords(F.col("text"))
    for r in documents(spark, sf_dir).select("text", words.alias("k")).collect():
        assert r.k == keyword_oracle(r.text, 10)


def test_keyword_details(spark):
    random.seed(3)
    vocabulary = ["with", "that", "thin", "from", "café", "x2y", "9lives", "über", "ab", "Python", "a_b"]
    texts = [" ".join(random.choices(vocabulary, k=random.randint(0, 60))) for _ in range(60)] + ["", None]
    got = column(spark, texts, lambda c: E.keywords(c, 4, boosted=CORPUS_BOOST))
    assert got == [keyword_oracle(t or "", 4, CORPUS_BOOST) for t in texts]


def test_keywords_of_a_very_long_text(spark):
    text = " ".join(f"word{i % 7000}" for i in range(60_000))
    assert column(spark, [text], lambda c: E.keywords(c, 3)) == [["word0", "word1", "word2"]]


def test_sentiment_equals_a_row_by_row_oracle(spark, sf_dir):
    mood = E.sentiment(F.col("text"), CORPUS_LEXICON)
    for r in documents(spark, sf_dir).select("text", mood.alias("m")).collect():
        found = set(re.findall(r"\w+", r.text.lower()))
        p = sum(w in found for w in CORPUS_LEXICON.positive)
        n = sum(w in found for w in CORPUS_LEXICON.negative)
        label = "neutral" if p == n else ("positive", "negative")[n > p]
        assert (r.m.label, r.m.positive, r.m.negative) == (label, p, n)
        assert r.m.confidence == abs(p - n) / max(1, len(found))


def test_sentiment_lines(spark):
    texts = [
        "Company announces record profits and growth", "Massive layoffs hit tech sector",
        "New software update released today", "", None,
    ]
    got = column(spark, texts, E.sentiment)
    assert [(m.label, m.confidence) for m in got] == [
        ("positive", 2 / 6), ("negative", 1 / 5), ("neutral", 0.0), ("neutral", 0.0), ("neutral", 0.0),
    ]


def test_entities(spark):
    text = "Meta and GOOGLE paid $5 meters, $1,200.50 million; metal $3 B $1 $2 $9"
    got = column(spark, [text, None], E.entities)
    assert got[0].companies == ["GOOGLE", "Meta"]
    assert got[0].amounts == ["$5 m", "$1,200.50 million", "$3 B", "$1", "$2"]
    assert got[1].companies == [] and got[1].technologies == [] and got[1].amounts == []


def test_recategorize_rounds_half_even_and_overwrites(spark):
    df = spark.createDataFrame(
        [("a cloud platform service", None, "an oracle", None), ("nothing", "", "", "Own")],
        "title string, content string, summary string, category string",
    )
    got = E.recategorize(df).collect()
    assert (got[0].category, got[0].ai_confidence) == ("Enterprise", 0.146)  # 7 of 48
    assert (got[1].category, got[1].ai_confidence) == ("Own", 0.0)


def test_enrich_adds_all_columns_without_a_shuffle(spark, sf_dir):
    out = E.enrich(V.table(spark, sf_dir, "documents").selectExpr(
        "source title", "text content", "'' summary", "lang category"))
    assert out.columns[-5:] == ["ai_category", "ai_confidence", "ai_keywords", "sentiment", "sentiment_score"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EvalPython" not in plan


def test_enrich_equals_the_single_steps(spark, sf_dir):
    df = V.articles_from_documents(spark, sf_dir)
    whole = E.enrich(df, CORPUS_RULES, CORPUS_LEXICON)
    steps = E.add_sentiment(E.add_keywords(E.add_category(df, CORPUS_RULES)), CORPUS_LEXICON)
    columns = ["_ord", *whole.columns[-5:]]
    assert sorted(whole.select(columns).collect()) == sorted(steps.select(columns).collect())


def test_keywords_are_counted_in_runs_of_sorted_words(spark):
    """Words are sorted as plain strings, not as structs with their places; top words, ties, doubled counts,
    short lists and single letters as by counting one by one."""
    rng = random.Random(3)
    vocabulary = ["a", "b2", "be", "bee", "bees", "the", "ai", "api", "x", "rust", "rusty", "é", "x_y", "9z"]
    texts = [" ".join(rng.choices(vocabulary, k=n)) for n in range(60)]
    for k, least in ((1, 1), (3, 2), (5, 3), (50, 1)):
        def expected(text):
            found = [w for w in re.findall(r"(?<!\w)[a-z][a-z0-9]*(?!\w)", text) if len(w) >= least and w not in R.STOP_WORDS]
            counts = {w: found.count(w) * (2 if w in R.TECH_TERMS else 1) for w in dict.fromkeys(found)}
            return sorted(counts, key=lambda w: -counts[w])[:k]

        assert column(spark, texts, lambda c: E.keywords(c, k, least)) == [expected(t) for t in texts]
    df = spark.createDataFrame([("x",)], "text string").select(E.keywords(F.col("text")))
    assert "array_join(sort_array(" in df._jdf.queryExecution().optimizedPlan().toString()
