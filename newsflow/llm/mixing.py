"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted in cells of source, language and topic.  Raking multiplies
the cells by one factor per source, language and topic until the weighted
margins meet their targets; a document is then kept with its cell's
probability.  Cells are a Spark table throughout, so their number may grow with
the corpus.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import fresh_name, small_side, stage, staging
from newsflow.llm.quality import words_of

# A document's topic is the list with most of its words; the first one of a tie.
TOPICS: dict[str, tuple[str, ...]] = {
    "legal": ("license", "licensed", "copyright", "warranty", "terms", "public"),
    "contact": ("email", "mail", "call", "phone", "contact", "address"),
    "account": ("password", "key", "token", "secret", "login", "user"),
}
OTHER = "other"
SMOOTH = 0.7  # without targets, margins are flattened by this power
SHARE = 0.8  # of all tokens kept
TOLERANCE = 1e-4  # of a target, that a margin may be off
FALLING = 0.99  # a sweep that leaves more of the deviation than this ends the raking
DIMENSIONS = ("source", "lang", "topic")


def topic_of(words: Column, topics: Mapping[str, tuple[str, ...]] = TOPICS) -> Column:
    """Topic by counted words, A-Z lower-cased, punctuation at the ends cut."""
    plain = F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(".,:;!?()\"'")))

    def counted(own: tuple[str, ...]) -> Column:
        return F.size(F.filter(plain, lambda w: w.isin(*own)))

    named = F.array(*[
        F.struct(counted(own).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name"))
        for i, (name, own) in enumerate(topics.items())
    ])
    best = F.array_max(named)
    return F.when(best["n"] > 0, best["name"]).otherwise(F.lit(OTHER))


def described(
    docs: DataFrame, text_col: str = "text", topics: Mapping[str, tuple[str, ...]] = TOPICS
) -> tuple[DataFrame, str]:
    """``docs`` with one more struct column (source, lang, topic, tokens), and
    its name.

    Null sources and languages are empty strings; a null text has no tokens.
    Tokens are words, and at least one, so empty documents are drawn too.
    """
    name = fresh_name(docs, "mix")
    words = words_of(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    # a word list occurs in few texts: look before splitting them for their topic
    anyone = "|".join(sorted({w for own in topics.values() for w in own}))
    maybe = F.rlike(F.lower(F.col(f"`{text_col}`")), F.lit(anyone)) if anyone else F.lit(False)
    topic = F.when(maybe, topic_of(words, topics)).otherwise(F.lit(OTHER)) if topics else F.lit(OTHER)
    return docs.withColumn(name, F.struct(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        topic.alias("topic"),
        F.greatest(F.size(words), F.lit(1)).cast("bigint").alias("tokens"),
    )), name


def _targets(cells: DataFrame, dimension: str, given: Mapping[str, float] | None) -> DataFrame:
    """(value, share) of one margin: the shares given, the rest of the mass
    spread over the other values by their smoothed tokens."""
    margin = cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens"))
    smooth = F.pow(F.col("tokens").cast("double"), F.lit(SMOOTH))
    if given:
        table = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
        margin = margin.withColumn("given", F.try_element_at(table, F.col(dimension)).cast("double"))
    else:
        margin = margin.withColumn("given", F.lit(None).cast("double"))
    total = margin.agg(F.sum("given").alias("g"), F.sum(F.when(F.col("given").isNull(), smooth)).alias("s")).first()
    if total is None or (total["g"] is None and total["s"] is None):
        return margin.select(dimension, F.lit(0.0).alias("share"))
    fixed, rest = float(total["g"] or 0.0), float(total["s"] or 0.0)
    left = max(1.0 - fixed, 0.0) if rest else 0.0
    mass = fixed + left
    share = F.coalesce(F.col("given"), smooth * (left / rest if rest else 0.0)) / mass
    return margin.select(dimension, share.alias("share"))


def rake(
    cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, tolerance: float = TOLERANCE,
) -> DataFrame:
    """Cells (source, lang, topic, tokens) with a ``weight`` such that the
    weighted tokens have the target shares in every dimension, and ``deviation``,
    how far the worst margin still is from its target, as a part of it.

    Each sweep scales by source, language and topic in turn and is staged.  It
    ends when no margin is off by more than ``tolerance``, or, where targets
    contradict each other, when the deviation doesn't fall any more: then it is
    larger than ``tolerance``, and the caller sees so.
    """
    with staging(cells.sparkSession) as own:
        return stage(_raked(cells, targets, tolerance, own), "weights")


def _deviation(now: DataFrame, goals: Mapping[str, DataFrame], total: float) -> float:
    """The largest relative distance of a margin from its target, by one job."""
    off = [
        now.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("mass")).join(goals[d], d)
        .select((F.abs(F.col("mass") / total - F.col("share")) / F.greatest("share", F.lit(1e-9))).alias("off"))
        for d in DIMENSIONS
    ]
    return reduce(DataFrame.unionByName, off).agg(F.max("off")).first()[0] or 0.0


def _raked(cells: DataFrame, targets, tolerance: float, own) -> DataFrame:
    goals = {d: own(_targets(cells, d, (targets or {}).get(d)), "targets") for d in DIMENSIONS}
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now, off, before = cells.withColumn("weight", F.lit(1.0)), 0.0, float("inf")
    while total:
        for d in DIMENSIONS:
            margin = now.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("mass")).join(
                goals[d], d).select(d, F.when(F.col("mass") > 0, F.col("share") * total / F.col("mass"))
                                    .otherwise(F.lit(0.0)).alias("factor"))
            now = now.join(margin, d).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        now = own(now.select(*DIMENSIONS, "tokens", "weight"), "raked")
        off = _deviation(now, goals, total)
        if off <= tolerance or off > FALLING * before:
            break
        before = off
    return now.withColumn("deviation", F.lit(float(off)))


def probabilities(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """Cells with ``probability``: min(1, scale * weight), where the scale makes
    the expected tokens ``share`` of all.

    Cells that reach 1 are kept whole; the scale of the others is raised until
    the sum is met, one Spark aggregation for each step.  Every step but the last
    makes at least one cell more whole, so it ends.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    want, scale, whole_cells = share * total, 0.0, -1
    while True:
        reached = F.col("weight") * scale >= 1
        row = cells.agg(
            F.count_if(reached).alias("cells"),
            F.sum(F.when(reached, F.col("tokens"))).alias("whole"),
            F.sum(F.when(~reached, F.col("tokens") * F.col("weight"))).alias("open"),
        ).first()
        whole, free = float(row["whole"] or 0), float(row["open"] or 0)
        if row["cells"] <= whole_cells or free <= 0 or whole >= want:
            break
        whole_cells, scale = row["cells"], (want - whole) / free
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(scale)))


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the values only."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    targets: Mapping[str, Mapping[str, float]] | None = None, share: float = SHARE,
    topics: Mapping[str, tuple[str, ...]] = TOPICS, drop: tuple[str, ...] = (),
) -> DataFrame:
    """``docs`` without the columns in ``drop``, with topic, n_tokens, weight,
    probability and ``sampled``.

    The draw hashes the id and the text, so it is the same on every run; rows
    that are equal in both share their fate.  Same-named columns are replaced.
    The texts are read once: rows are staged with their cell.
    """
    marked, mix = described(docs, text_col, topics)
    added = ["topic", "n_tokens", "weight", "probability", "sampled"]
    kept = [c for c in docs.columns if c.lower() not in added and c not in drop]
    rows = stage(
        marked.select(
            F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"),
            uniform(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("u"), F.col(f"{mix}.*")),
        "marked",
    )
    cells = stage(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    drawn = stage(probabilities(rake(cells, targets), share).drop("tokens", "deviation"), "probabilities")
    return rows.join(small_side(drawn), list(DIMENSIONS)).select(
        *[F.col("row")[c].alias(c) for c in kept],
        "topic", F.col("tokens").alias("n_tokens"), "weight", "probability",
        (F.col("u") < F.col("probability")).alias("sampled"),
    )
