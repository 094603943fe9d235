"""Shared means of the training-data operators: staging, size-checked
broadcasts, connected components, Arrow tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.session import discard, fresh_path, staging  # noqa: F401

# A staged table of at most this size may be broadcast; larger ones are joined
# by shuffling both sides.
BROADCAST_BYTES = 32 << 20
# Rows per batch handed to Python: texts are large rows.
ARROW_BYTES = 16 << 20


def travels(module: str) -> None:
    """Send the functions of a module with their tasks: executors need not
    have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


_RECORDS: list[list[str]] = []


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Note in ``paths`` what operators leave staged for their lazy results
    inside the block, so that the caller can discard it once they are written."""
    _RECORDS.append(paths)
    try:
        yield
    finally:
        _RECORDS.pop()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here
    and a lost executor costs nothing that was written.

    For tables that an operator's lazy result reads; what only the operator
    itself reads is staged in a ``staging`` block and deleted at its end."""
    path = fresh_path(df.sparkSession, name)
    for paths in _RECORDS:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(staged: DataFrame) -> int:
    """Size of the files behind a staged table."""
    spark = staged.sparkSession
    total = 0
    for name in staged.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
        if total > BROADCAST_BYTES:
            break
    return total


def small_side(staged: DataFrame) -> DataFrame:
    """Hint a broadcast for a staged table, if its files are small."""
    return F.broadcast(staged) if stored_bytes(staged) <= BROADCAST_BYTES else staged


def text_batches(spark: SparkSession) -> None:
    """Bound what Arrow hands to Python at once by bytes, not only by rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, underscored until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def replace_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """All columns of ``df`` with these added; a clashing name is replaced."""
    names = {c.lower() for c in columns}
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c.lower() not in names],
        *[v.alias(k) for k, v in columns.items()],
    )


STEPS = 64  # of the component search; it needs about the logarithm of the longest path


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as (u, v) long rows.

    Alternates large-star and small-star steps until the edges stay the same,
    each compared with the step before; every step is reduced by key before it
    is shuffled, so a vertex with very many neighbours costs one row per task,
    and its joins are split by AQE.  Steps are staged, and each is deleted when
    the next one is written.  Raises if ``STEPS`` aren't enough.
    Returns (node, component) for every node except the smallest of each
    component.
    """
    spark = edges.sparkSession
    with staging(spark) as own:
        now = own(
            edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
            "edges",
        )
        size, paths = now.count(), []
        for _ in range(STEPS):
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m"))
            large = both.join(least, "u").where("v > u").select(
                F.col("v").alias("u"), F.least("u", "m").alias("v")
            ).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(
                F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                  F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
            ).select("e.*").where("u <> v").distinct()
            path = fresh_path(spark, "edges")
            small.write.parquet(path)
            after = spark.read.schema(small.schema).parquet(path)
            count = after.count()
            same = count == size and after.join(now, ["u", "v"], "left_anti").isEmpty()
            for old in paths:
                discard(spark, old)
            now, size, paths = after, count, [path]
            if same:
                break
        else:
            discard(spark, path)
            raise RuntimeError(f"components: edges still change after {STEPS} steps")
        found = stage(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "components")
        for old in paths:
            discard(spark, old)
        return found
