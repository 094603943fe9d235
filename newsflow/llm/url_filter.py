"""URL filter: host and path rules, and a character model for the rest.

URLs that a rule accepts or rejects train two variable-order Markov models over
characters.  A URL without a rule is judged by the difference of its
log-likelihoods, per character, against a threshold calibrated on ruled URLs
that the models have not seen.  Column expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import small_side, stage

ORDER = 3  # characters of the longest context
# Characters are folded to 32 symbols: a-z, 0 for digits, the marks below, ~ for
# anything else and ^ before the start.  So there are at most 32 ** (ORDER + 1)
# entries in the model.
MARKS = "/.-"
SYMBOLS = 26 + 1 + len(MARKS) + 2
FOLDS = 5  # one of so many ruled URLs calibrates the threshold
STEPS = 200  # calibration bins per unit of the score
REACH = 10 * STEPS

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def folded(url: Column) -> Column:
    """The URL after its scheme in the model's symbols, with the start marks."""
    rest = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""))
    rest = F.regexp_replace(F.translate(rest, "123456789_", "000000000-"), r"(?s)[^a-z0/.\-]", "~")
    return F.concat(F.lit("^" * ORDER), rest)


def _positions(urls: DataFrame) -> DataFrame:
    """One row per character with its context: ``gram``, ORDER + 1 symbols."""
    last = F.length("symbols") - ORDER
    at = F.explode(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")))
    return urls.select("*", at.alias("at")).withColumn("gram", F.expr(f"substring(symbols, at, {ORDER + 1})")).drop(
        "symbols", "at")


def markov_scores(grams: DataFrame) -> DataFrame:
    """(gram, score): log-likelihood ratio of each character in its context.

    ``grams`` has the counts ``accepted`` and ``rejected`` of every gram.  Each
    order is smoothed into the one below by Witten and Bell's rule: the weight
    of the lower order is the number of different successors of the context.  A
    context never seen leaves the lower order as it is, so the order in use
    varies with the data.
    """
    below = None
    for k in range(ORDER + 1):
        own = grams.groupBy(F.expr(f"right(gram, {k + 1})").alias("s")).agg(
            F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
        own = own.withColumn("context", F.expr(f"left(s, {k})"))
        context = own.groupBy("context").agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"),
            F.sum(F.when(F.col("a") > 0, 1).otherwise(0)).alias("ta"),
            F.sum(F.when(F.col("r") > 0, 1).otherwise(0)).alias("tr"))
        table = own.join(context, "context")
        if below is None:
            table = table.withColumns({"pa": F.lit(1.0 / SYMBOLS), "pr": F.lit(1.0 / SYMBOLS)})
        else:
            table = table.withColumn("suffix", F.expr(f"right(s, {k})")).join(
                below.withColumnRenamed("s", "suffix"), "suffix")

        def smoothed(n, seen, types, lower):
            mixed = (F.col(n) + F.col(types) * F.col(lower)) / (F.col(seen) + F.col(types))
            return F.when(F.col(seen) > 0, mixed).otherwise(F.col(lower))

        below = table.select("s", smoothed("a", "na", "ta", "pa").alias("pa"), smoothed("r", "nr", "tr", "pr").alias("pr"))
    return below.select(F.col("s").alias("gram"), (F.log("pa") - F.log("pr")).alias("score"))


def _threshold(scored: DataFrame) -> float:
    """The score from which the unseen ruled URLs are told apart best (mean of
    both classes' hit rates), from a histogram of at most 2 * REACH + 1 bins."""
    bins = F.greatest(F.least(F.floor(F.col("score") * STEPS), F.lit(REACH)), F.lit(-REACH)).alias("bin")
    rows = scored.groupBy(bins).agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("r"),
    ).orderBy("bin").collect()
    accepted, rejected = sum(r["a"] for r in rows), sum(r["r"] for r in rows)
    if not accepted or not rejected:
        return 0.0
    best, at, lost, caught = -1.0, 0.0, 0, 0
    for r in rows:  # everything below this bin is rejected
        rate = (accepted - lost) / accepted + caught / rejected
        if rate > best + 1e-12:
            best, at = rate, r["bin"] / STEPS
        lost, caught = lost + r["a"], caught + r["r"]
    return at


def url_filter(pages: DataFrame, *, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, score (mean log-likelihood ratio per
    character) and verdict.

    Each distinct URL is counted and scored once, weighted by its rows.  A null
    URL, or one without ``://``, has empty host and path, no rule, and an
    accepted score where the threshold is not above 0 or its own characters
    score.  Without ruled URLs of both kinds the threshold is 0 and ties are
    accepted.  Same-named columns are replaced; repeated rows all come back.
    """
    url = F.col(f"`{url_col}`").cast("string")
    host, path = host_and_path(F.col("url"))
    distinct = pages.groupBy(url.alias("url")).agg(F.count("*").alias("n")).where("url IS NOT NULL")
    rule, verdict = first_rule(host, path, rules)
    unseen = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(FOLDS)) == 0
    distinct = distinct.select("url", "n", verdict.alias("verdict"), unseen.alias("unseen"))
    distinct = stage(distinct, "urls")
    position = _positions(distinct.withColumn("symbols", folded(F.col("url"))))
    learns = ~F.col("unseen")
    grams = stage(position.groupBy("gram").agg(
        F.sum(F.when(learns & (F.col("verdict") == "allow"), F.col("n")).otherwise(0)).alias("accepted"),
        F.sum(F.when(learns & (F.col("verdict") == "block"), F.col("n")).otherwise(0)).alias("rejected"),
    ), "grams")
    model = stage(markov_scores(grams), "model")
    scored = stage(
        position.join(small_side(model), "gram").groupBy("url").agg(
            F.avg("score").alias("score"), F.first("verdict").alias("verdict"), F.first("n").alias("n"),
            F.first("unseen").alias("unseen")),
        "scores",
    )
    threshold = _threshold(scored.where("unseen AND verdict IS NOT NULL"))
    key = scored.select(F.col("url").alias("scored_url"), F.col("score").alias("scored"))
    names = [c for c in pages.columns]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), url.alias("url"))
    joined = rows.join(key, F.col("url") == F.col("scored_url"), "left").select(
        "row", "url", F.coalesce("scored", F.lit(0.0)).alias("score"))
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    judged = joined.withColumns({"host": host, "path": path}).withColumns(
        {"rule": rule, "ruled": verdict})
    chosen = F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    added = ("host", "path", "rule", "score", "verdict")
    kept = [c for c in names if c.lower() not in added]
    return judged.withColumn("verdict", chosen).select(*[F.col("row")[c].alias(c) for c in kept], *added)
