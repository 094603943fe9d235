"""Packing documents into batches: optimal length buckets.

Documents are cut into sequences of at most ``max_tokens``.  The histogram of
sequence lengths over the whole corpus, at most ``max_tokens`` rows, goes through
a dynamic program that chooses the bucket bounds with the least padding.  Inside
a bucket, sequences are numbered without a gap and form batches of as many rows
as the token budget allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.functions.arrays import rows as literal_rows
from newsflow.llm.common import small_side, stage
from newsflow.llm.quality import words_of

MAX_TOKENS = 2048
BUCKETS = 8
BUDGET = 16_384  # tokens of a batch, padding included
PART = 20_000  # sequences numbered together


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    ``cost(i, j)``, the padding if lengths i..j share a bucket, comes from prefix
    sums; ``best[k][j]`` is the least padding of the first j lengths in k
    buckets.  Every length is a possible bound, so the result is exact.
    """
    n = len(lengths)
    if not n:
        return []
    number = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    best = lengths * number[1:] - tokens[1:]
    choices = []
    for _ in range(min(buckets, n) - 1):
        new, choice = best.copy(), np.full(n, -1)
        for j in range(1, n):
            # the last bucket holds lengths i+1..j, the ones before end at i
            cost = lengths[j] * (number[j + 1] - number[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            total = best[:j] + cost
            i = int(total.argmin())
            if total[i] < new[j]:
                new[j], choice[j] = total[i], i
        choices.append(choice)
        best = new
    bounds, j = [], n - 1
    for choice in reversed(choices):
        if j >= 0 and choice[j] >= 0:
            bounds.append(int(lengths[j]))
            j = int(choice[j])
    bounds.append(int(lengths[j]))
    return sorted(set(bounds))


def sequences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, piece, start, n_tokens): each document's words and one end mark,
    cut into pieces of at most ``max_tokens``."""
    tokens = F.size(words_of(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))) + 1
    counted = docs.select(F.col(f"`{id_col}`").alias("doc_id"), tokens.alias("tokens"))
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(tokens - 1) div {max_tokens}")))
    cut = counted.select("doc_id", "tokens", piece.alias("piece"))
    start = F.col("piece") * max_tokens
    return cut.select("doc_id", "piece", start.alias("start"),
                      F.least(F.col("tokens") - start, F.lit(max_tokens)).cast("bigint").alias("n_tokens"))


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS,
    buckets: int = BUCKETS, budget: int = BUDGET,
) -> DataFrame:
    """One row per sequence: doc_id, piece, start, n_tokens, bucket, padded_to,
    batch_id, slot.

    Whole texts: the pieces of a document cover all its tokens, and an empty or
    null text is one sequence, its end mark.  All batches of a bucket but its
    last are full.  Sequences are numbered by bucket, hashed part, id, piece;
    equal rows get different slots.  Null ids are kept.
    """
    if budget < max_tokens:
        raise ValueError(f"a batch of {budget} tokens cannot hold a sequence of {max_tokens}")
    cut = stage(sequences(docs, id_col=id_col, text_col=text_col, max_tokens=max_tokens), "sequences")
    # at most max_tokens rows: bounded whatever the corpus
    histogram = cut.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toPandas()
    lengths, counts = histogram["n_tokens"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64)
    bounds = optimal_bounds(lengths, counts, buckets)
    table = literal_rows(({"bucket": i, "bound": b} for i, b in enumerate(bounds)), "bucket int, bound bigint")
    own = F.get(F.filter(table, lambda b: b["bound"] >= F.col("n_tokens")), F.lit(0))
    parts = max(1, -(-int(counts.sum()) // PART))
    placed = cut.withColumn("own", own).select(
        "*", F.col("own.bucket").alias("bucket"), F.col("own.bound").alias("padded_to"),
        F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).alias("part"),
    ).drop("own")
    # numbers inside a part, then the parts' first numbers: no window over a whole bucket
    sizes = stage(placed.groupBy("bucket", "part").agg(F.count("*").alias("rows")), "parts")
    first = stage(sizes.select(
        "bucket", "part",
        (F.sum("rows").over(Window.partitionBy("bucket").orderBy("part")) - F.col("rows")).alias("first")), "firsts")
    inner = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "piece")) - 1
    numbered = placed.withColumn("inner", inner).join(small_side(first), ["bucket", "part"])
    capacity = F.expr(f"{budget} div padded_to")
    number = F.col("first") + F.col("inner")
    return numbered.select(
        "doc_id", "piece", "start", "n_tokens", "bucket", "padded_to",
        F.concat_ws("-", "bucket", F.floor(number / capacity).cast("bigint")).alias("batch_id"),
        (number % capacity).cast("bigint").alias("slot"),
    )
