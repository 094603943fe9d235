"""Corpus pipeline: rules, near duplicates, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir), is written as Parquet and read again as
the next one's documents.  All but the last return the columns of ``documents``.

1. quality rules: documents that fail, or whose host fails, go
2. n-gram Jaccard join: the first document of each group stays
   (five-word shingles, similarity 0.8)
3. suffix-array dedup: passages of 100 bytes that occurred before go
4. mixing: documents are drawn towards flatter source, language and topic shares
5. packing: sequences in length buckets and batches
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.common import recorded
from newsflow.llm.jaccard import first_of_groups
from newsflow.llm.mixing import mix_sources
from newsflow.llm.packing import pack
from newsflow.llm.quality import quality_rules
from newsflow.llm.suffix_dedup import suffix_dedup
from newsflow.session import discard, fresh_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


# What each stage's operator left in the shared folder for its lazy result.  The
# next stage gets that result written, so it deletes the tables first.
_LEFT: dict[str, list[str]] = {}


def _after(previous: str | None):
    def decorate(function):
        @wraps(function)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for path in _LEFT.pop(previous, ()):
                discard(spark, path)
            left: list[str] = []
            with recorded(left):
                out = function(spark, docs, sf_dir)
            _LEFT[function.__name__] = left
            return out

        return run

    return decorate


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


@_after(None)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host passes.

    A null text has no words and fails; a null source is a host of its own.  Rows
    are judged one by one, repeated and id-less ones too; an empty table stays
    empty.  Columns other than those of ``documents`` are dropped.
    """
    return _documents(quality_rules(docs.select(*COLUMNS)).where("kept"))


@_after("quality")
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates.

    Empty, blank and null texts are like nothing and stay, as do rows without
    id.  Rows that repeat an id are one document: they stay or go together.
    """
    return _documents(first_of_groups(docs, width=5, percent=80))


@_after("near_duplicates")
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes that occurred before, and their new
    lengths in code points.

    Null texts stay null-length rows: they come back as empty texts.  Equal rows
    are one document and are cut alike; rows without id are left as they are.
    """
    cut = suffix_dedup(docs.select(*COLUMNS), length=100)
    return _documents(cut.withColumn("n_chars", F.length("text").cast("bigint")))


@_after("repeated_passages")
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw towards flatter source, language and topic shares.

    Null sources and languages count as empty strings, empty and null texts as
    one token.  Rows equal in id and text share their fate.
    """
    return _documents(mix_sources(docs.select(*COLUMNS)).where("sampled"))


@_after("mixing")
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and batches.

    Empty and null texts are one sequence, their end mark; rows without id are
    packed too, equal rows get different slots.
    """
    return pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]

# Segments, run-length index and raking are no SQL: the tests compare with
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written for the next one and deleted
    when that one is written too."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES[:-1]:
        path = fresh_path(spark, name)
        kept = function(spark, docs, sf_dir)
        kept.write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(spark, before)  # packing has counted the texts and reads them no more
    return packed
