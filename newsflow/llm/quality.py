"""Quality rules of documents and hosts, in column expressions only.

Every document is measured inside its row.  A host (source, domain) is judged
by the share of its documents that fail: the shares are shrunk towards the
corpus by a beta prior fitted to all hosts, so a host with few documents is not
condemned for one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.arrays import bind
from newsflow.llm.common import fresh_name, replace_columns, small_side, stage

# Blanks, and characters counted as symbols.
BLANK = r"[ \t\n\x0B\f\r]"
SYMBOL = r"[#*$%&|<>]"

WINDOW = 8  # words of a window that may not come twice
MIN_WORDS = 20
REPEAT_PERCENT = 30
HOST_RATE = 0.5  # a host is rejected from this shrunk failure rate


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII blanks."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK + "+")).otherwise(
        F.array().cast("array<string>"))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the text.

    Windows are compared by 64-bit hashes.  Texts in which no window repeats,
    most of them, are done after counting the distinct hashes.
    """

    def covered(hashes: Column) -> Column:
        def of_sorted(ordered: Column) -> Column:
            # positions whose hash equals a neighbour's in hash order
            def repeats(e: Column, i: Column) -> Column:
                after = F.get(ordered, i + 1)["h"].eqNullSafe(e["h"])
                return after | ((i > 0) & (F.get(ordered, i - 1)["h"] == e["h"]))

            places = F.sort_array(F.transform(F.filter(ordered, repeats), lambda e: e["i"]))

            # each covers the words up to the next one, at most a window
            def spread(p: Column) -> Column:
                widths = F.transform(
                    p, lambda at, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - at, F.lit(window))))
                return F.aggregate(widths, F.lit(0), lambda a, w: a + w)

            return bind(places, spread)

        numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            bind(F.sort_array(numbered), of_sorted))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, window)))

    return F.when(F.size(words) > window, bind(bind(words, windows), covered)).otherwise(F.lit(0))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^ \t\n\x0B\f\r]")))
    return F.when(
        F.contains(text, F.lit("\n")), bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    ).otherwise(F.lit(0))


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def document_stats(
    docs: DataFrame, *, text_col: str = "text", min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT
) -> DataFrame:
    """``docs`` with the columns of ``STATS``; same-named ones are replaced.

    ``base_failed``: fewer than ``min_words`` words, or more than
    ``repeat_percent`` per cent of them in repeated windows.  A null text has no
    words and fails.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    def measure(x: Column) -> Column:
        t, w = x["t"], x["w"]
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            (F.length(t) - F.length(F.regexp_replace(t, SYMBOL, ""))).cast("bigint").alias("n_symbols"),
            duplicate_lines(t).cast("bigint").alias("n_dup_lines"),
            repeated_words(w).cast("bigint").alias("n_repeat_words"),
        )

    stats = bind(F.struct(text.alias("t"), words_of(text).alias("w")), measure)
    name = fresh_name(docs, "quality_stats")
    # the array keeps the struct from being computed once for each of its fields
    measured = docs.withColumn(name, F.explode(F.array(stats)))
    s = F.col(name)
    failed = (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > repeat_percent * s["n_words"])
    added = {k: s[k] for k in STATS[:-1]} | {"base_failed": failed}
    return replace_columns(measured.select(*[F.col(f"`{c}`") for c in docs.columns], name), added).drop(name)


def host_verdicts(measured: DataFrame, *, host_col: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk rate and verdict.

    The beta prior has the mean of all documents; its weight follows from the
    spread of the hosts' rates by the method of moments, each host weighted by
    its documents: with observed weighted variance s2 around mean m, and the
    part of it that chance alone explains taken off, the weight is
    m (1 - m) / s2 - 1.  Hosts that do not differ more than by chance all get
    the mean.  A null host is a host of its own.
    """
    counts = stage(
        measured.groupBy(F.col(f"`{host_col}`").alias("host")).agg(
            F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("bigint")).alias("failed")),
        "hosts",
    )
    total = counts.select(
        F.sum("docs").alias("n"), F.sum("failed").alias("f"), F.count("*").alias("hosts"),
        F.sum(F.col("docs") * F.pow(F.col("failed") / F.col("docs"), 2)).alias("squares"),
    ).first()
    n, hosts = total["n"] or 0, total["hosts"]
    mean = total["f"] / n if n else 0.0
    spread = total["squares"] / n - mean * mean if n else 0.0
    chance = mean * (1 - mean) * max(hosts - 1, 0) / n if n else 0.0
    between = spread - chance
    weight = max(mean * (1 - mean) / between - 1, 0.0) if between > 1e-12 else None
    if weight is None:  # no spread beyond chance
        rate = F.lit(mean)
    else:
        rate = (F.col("failed") + weight * mean) / (F.col("docs") + weight)
    return counts.withColumn("host_rate", rate.cast("double")).withColumn(
        "host_rejected", F.col("host_rate") >= host_rate)


def quality_rules(
    docs: DataFrame, *, text_col: str = "text", host_col: str = "source", drop: tuple[str, ...] = (),
    host_rate: float = HOST_RATE,
) -> DataFrame:
    """``docs`` with the measures of ``STATS``, host_rate and ``kept``: false if
    the document or its host fails.

    The measured rows are staged once, without the columns in ``drop``; hosts
    are then joined back.  Every input row comes back, repeated ones too.
    """
    measured = stage(document_stats(docs, text_col=text_col).drop(*drop), "measured")
    verdicts = stage(
        host_verdicts(measured, host_col=host_col, host_rate=host_rate).select("host", "host_rate", "host_rejected"),
        "verdicts",
    )
    host = fresh_name(measured, "verdict_host")
    rate, rejected = fresh_name(measured, "verdict_rate"), fresh_name(measured, "verdict_rejected")
    side = small_side(verdicts.select(
        F.col("host").alias(host), F.col("host_rate").alias(rate), F.col("host_rejected").alias(rejected)))
    joined = measured.join(side, F.col(f"`{host_col}`").eqNullSafe(F.col(host)), "left")
    return replace_columns(
        joined, {"host_rate": F.col(rate), "kept": ~F.col("base_failed") & ~F.coalesce(F.col(rejected), F.lit(False))}
    ).drop(host, rate, rejected)
