"""Interaction of quality filters, audited under every order of them.

What a sequence of filters keeps and removes depends on a document only through
the set of filters it fails.  The corpus is therefore counted once, into one
cell for each part and set of failures; a part's cells are a tensor with one
axis of length two (pass, fail) per filter.  Every figure of a step is a
contraction of that tensor that takes pass, fail or all along each axis.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.arrays import bind
from newsflow.llm.common import travels
from newsflow.llm.quality import words_of

travels(__name__)

# Characters that filter D looks for, and the upper-case letters of C.
SYMBOLS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3

COPY = "E"  # the filter that looks at other documents
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)

REPORT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint")


def text_filters(
    min_words: int = MIN_WORDS, distinct_percent: int = DISTINCT_PERCENT, capital_percent: int = CAPITAL_PERCENT
):
    """Failure conditions of the filters that need one text only, by letter;
    each gets the text and its words."""

    def capitals(text: Column, words: Column) -> Column:
        found = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
        return 100 * found.cast("bigint") > capital_percent * F.length(text).cast("bigint")

    return {
        "A": lambda text, words: F.size(words) < min_words,
        "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < distinct_percent * F.size(words),
        "C": capitals,
        "D": lambda text, words: F.rlike(text, F.lit(SYMBOLS)),
    }


def failure_cells(
    docs: DataFrame, labels: DataFrame, *, filters=None, id_col: str = "doc_id", text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """(part, cell, n, good, toxic): documents by part and set of failed
    filters; bit i of ``cell`` stands for the i-th letter in alphabetical order,
    the copy filter E included.

    A document fails E if a document with a smaller id has the same text (equal
    SHA-256); among rows that share an id none is a copy of the other.
    Rows without an id fail E never and make nothing fail it.  Equal texts fail
    the other filters alike, so a text's rows are added up by part before they
    meet: a text that a third of all rows share sends one row per task and part.
    """
    filters = text_filters() if filters is None else filters
    letters = sorted([*filters, COPY])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    def failed(words: Column) -> Column:
        bits = [F.when(filters[c](F.col("text"), words), 1 << i).otherwise(0)
                for i, c in enumerate(letters) if c != COPY]
        return sum(bits, F.lit(0))

    digest = F.unhex(F.sha2("text", 256))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc"), text.alias("text"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
    ).select("doc", "part", digest.alias("same"), bind(words_of(F.col("text")), failed).alias("cell"))
    marked = labels.select(
        F.col(f"`{id_col}`").cast("bigint").alias("marked_doc"), F.col("quality"), F.col("toxic")
    ).groupBy("marked_doc").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("bigint")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("bigint")).alias("toxic"),
    )
    # rows without an id find no label; a hash in its place deals them out
    spread = F.coalesce("doc", F.xxhash64("same", "part"))
    rows = rows.withColumn("place", spread).join(
        marked, (F.col("place") == F.col("marked_doc")) & F.col("doc").isNotNull(), "left")
    by_id = rows.groupBy("place", "doc", "same", "part", "cell").agg(
        F.count("*").alias("n"), F.coalesce(F.max("good"), F.lit(0)).alias("good"),
        F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    by_id = by_id.select("doc", "same", "part", "cell", "n",
                         (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))
    measures = ("n", "good", "toxic")
    by_part = by_id.groupBy("same", "part", "cell").agg(
        *[F.sum(m).alias(m) for m in measures],
        F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", *measures))).alias("first"),
        *[F.sum(F.when(F.col("doc").isNull(), F.col(m)).otherwise(0)).alias(f"free_{m}") for m in measures])
    # a text has at most one row per part here
    by_text = by_part.groupBy("same", "cell").agg(
        F.min("first.doc").alias("first"),
        F.collect_list(F.struct("part", *measures, F.col("first").alias("own"), *[f"free_{m}" for m in measures])
                       ).alias("parts"))
    part = by_text.select("cell", "first", F.explode("parts").alias("p"))
    has_first = F.coalesce(F.col("p.own.doc") == F.col("first"), F.lit(False))

    def passing(m: str) -> Column:
        return F.col(f"p.free_{m}") + F.when(has_first, F.col(f"p.own.{m}")).otherwise(0)

    copy = 1 << letters.index(COPY)
    both = F.explode(F.array(
        F.struct(F.col("cell"), *[passing(m).alias(m) for m in measures]),
        F.struct((F.col("cell") + copy).alias("cell"), *[(F.col(f"p.{m}") - passing(m)).alias(m) for m in measures])))
    return part.select(F.col("p.part").alias("part"), both.alias("c")).select("part", "c.*").groupBy(
        "part", "cell").agg(*[F.sum(m).alias(m) for m in measures])


def contracted(tensor: np.ndarray, choice: list[tuple[int, int]]) -> list[int]:
    """Each measure (first axis) summed over the chosen ends of all other axes."""
    axes = range(1, tensor.ndim)
    operands = [tensor, list(range(tensor.ndim))]
    for axis, ends in zip(axes, choice, strict=True):
        operands += [np.array(ends, np.int64), [axis]]
    return np.einsum(*operands, [0]).tolist()


def step_report(tensor: np.ndarray, letters: str) -> list[tuple]:
    """Rows (order, step, kept, removed, redundant, unique fails, good lost,
    toxic lost, shapley) of a tensor (n, good, toxic) x 2 x ... x 2.

    ``shapley`` is what the step's filter removes, summed over all orders.
    """
    rows, shares = [], dict.fromkeys(letters, 0)
    for order in permutations(letters):
        for step, letter in enumerate(order, 1):
            earlier, upto = order[: step - 1], order[:step]
            kept = contracted(tensor, [PASS if c in upto else ALL for c in letters])
            removed = contracted(
                tensor, [FAIL if c == letter else PASS if c in earlier else ALL for c in letters])
            fails = contracted(tensor, [FAIL if c == letter else ALL for c in letters])
            alone = contracted(tensor, [FAIL if c == letter else PASS for c in letters])
            shares[letter] += removed[0]
            rows.append(("".join(order), step, kept[0], removed[0], fails[0] - removed[0], alone[0], *removed[1:]))
    return [(*row, shares[row[0][row[1] - 1]]) for row in rows]


def _report(letters: str):
    names = [f.split()[0] for f in REPORT.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        flat = np.zeros((3, 1 << len(letters)), np.int64)
        cell = table.column("cell").to_numpy()
        for i, m in enumerate(("n", "good", "toxic")):
            flat[i, cell] = table.column(m).to_numpy()
        # bit 0 of a cell is the last axis of the reshaped row
        tensor = flat.reshape(3, *[2] * len(letters)).transpose(0, *range(len(letters), 0, -1))
        rows = step_report(tensor, letters)
        part = table.column("part")[0].as_py()
        columns = [[part] * len(rows), *map(list, zip(*rows, strict=True))]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def filter_audit(docs: DataFrame, labels: DataFrame, *, filters=None, **options) -> DataFrame:
    """One row per part, order of all filters and step: documents kept after
    it, removed by it, failing its filter but gone before (``redundant``),
    failing its filter only (``unique_fails``), removed though labelled good,
    removed and labelled toxic, and what its filter removes over all orders
    (``shapley``).

    A null text is empty, a null part the empty string; a document with several
    labels counts as good or toxic if one of them says so, and unlabelled ones
    are neither.  Without documents there are no parts and no rows.  Columns
    other than id, text and part aren't read.  A task gets the cells of one
    part, 2 to the power of the number of filters at most.
    """
    filters = text_filters() if filters is None else filters
    letters = "".join(sorted([*filters, COPY]))
    cells = failure_cells(docs, labels, filters=filters, **options)
    return cells.groupBy("part").applyInArrow(_report(letters), REPORT)
