"""Table maintenance: keyed upsert, newest-N retention, run log.

Plain Parquet has no MERGE.  An upsert is therefore a query from (target,
batch) to the new rows; ``ParquetTable`` runs it on the hash buckets the batch
touches and overwrites these partitions, ``CatalogTable`` leaves it to MERGE.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.merge import MergeIntoWriter
from pyspark.sql.types import IntegerType, StructField, StructType

from newsflow import rules as R
from newsflow.functions.arrays import empty_strings
from newsflow.operators.cleaning import ORD
from newsflow.operators.joins import match_existing
from newsflow.schemas import ARTICLE_TABLE, SCRAPE_LOG, SOURCE
from newsflow.session import discard, staged, staging
from newsflow.sources.registry import default_sources, register_sources

PROTECTED = frozenset({"id", "created_at", "source_id"})
BUCKETS = 16  # of a stored table by default, by hash of the article key; take more for a large one


def _insert_defaults(now: Column) -> dict[str, Column]:
    """Values of a new article where the record has none."""
    return {
        "source_name": F.lit("unknown"),
        "scraped_at": now,
        "generated_at": now,
        "content": F.lit(""),
        "summary": F.lit(""),
        "content_length": F.lit(0),
        "has_content": F.lit(False),
        "category": F.lit(R.DEFAULT_CATEGORY),
        "tags": empty_strings(),
        "ai_confidence": F.lit(0.0),
        "ai_keywords": empty_strings(),
        "sentiment_score": F.lit(0.0),
        "extra_data": F.parse_json(F.lit("{}")),
    }


# defaults that also replace a null brought by the record
_NEVER_NULL = frozenset({"scraped_at", "generated_at", "extra_data"})


def prepare_batch(batch: DataFrame, target: DataFrame) -> DataFrame:
    """Batch rows that change the table, with ``_target`` (see
    ``match_existing``): rows with URL and title, the last one of each article.

    An article is a stored one, else a hash, and new articles with one URL are
    one.  Matching and choosing work on keys; whole rows take part in one join
    only.  Rows that share an ``_ord`` count as one row.
    """
    usable = F.col("url").isNotNull() & F.col("title").isNotNull()
    matched = match_existing(batch.where(usable).select(ORD, "hash_id", "url"), target)
    article = F.coalesce("_target", "hash_id", F.concat(F.lit("\n"), "url"))
    last = matched.groupBy(article.alias("_article"), "_target").agg(
        F.max(ORD).alias(ORD), F.max_by("url", ORD).alias("_url")
    )
    place = F.coalesce("_target", F.concat(F.lit("\n"), "_url"))
    last = last.groupBy(place.alias("_place"), "_target").agg(F.max(ORD).alias(ORD))
    return batch.join(last.select(ORD, "_target"), ORD).dropDuplicates([ORD])


def upsert_articles(
    target: DataFrame,
    batch: DataFrame,
    now: datetime | Column,
    stage: Callable[[DataFrame, str], DataFrame] = staged,
) -> DataFrame:
    """The target after the batch: matched articles take every column the batch
    has (keys and creation data stay), new ones are added with defaults.

    The matched batch is written to the shared folder first.  Its size is then
    known, so a small batch is broadcast and the target is read in place, and
    the merge does not repeat the matching.  The result reads what was written;
    ``stage`` of a ``staging`` block deletes it when the result has been used.
    """
    now = F.lit(now) if isinstance(now, datetime) else now
    prepared = stage(prepare_batch(batch, target), "prepared")
    return merge_prepared(target, prepared, now, _last_id(target))


def bucket_of(key: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def numbered(fresh: DataFrame, last_id: int) -> DataFrame:
    """``fresh`` with ``id``: above ``last_id``, without gaps, in order of hash
    bucket, key and arrival, so the same rows get the same numbers under any
    partitioning.  Numbers are dealt inside the buckets; the buckets' first
    numbers come from one row per bucket."""
    placed = fresh.withColumn("_bucket", bucket_of(F.coalesce("hash_id", "url"), 1024))
    sizes = placed.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_bucket")) - F.col("_rows")
    inner = F.row_number().over(Window.partitionBy("_bucket").orderBy("hash_id", "url", ORD))
    return (
        placed.withColumn("_inner", inner)
        .join(sizes.select("_bucket", before.alias("_before")), "_bucket")
        .withColumn("id", F.lit(last_id) + F.col("_before") + F.col("_inner"))
        .drop("_bucket", "_inner", "_before")
    )


def merge_prepared(target: DataFrame, prepared: DataFrame, now: Column, last_id: int = 0) -> DataFrame:
    """``upsert_articles`` for a batch that went through ``prepare_batch``;
    ``last_id`` is the largest id in use."""
    types = {f.name: f.dataType for f in target.schema.fields}
    incoming = [c for c in prepared.columns if c in types]
    taken = [c for c in incoming if c not in PROTECTED]
    changes = prepared.where(F.col("_target").isNotNull()).select(
        F.col("_target").alias("hash_id"),
        F.struct(*[F.col(c).cast(types[c]).alias(c) for c in taken]).alias("_new"),
    )
    hit = F.col("_new").isNotNull()
    kept = target.join(changes, "hash_id", "left").select(
        *[
            F.when(hit, now).otherwise(F.col(c)).cast(types[c]).alias(c)
            if c == "updated_at"
            else F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
            if c in taken
            else F.col(c)
            for c in target.columns
        ]
    )
    return kept.unionByName(inserted_rows(target, prepared, now, last_id))


def inserted_rows(target: DataFrame, prepared: DataFrame, now: Column, last_id: int) -> DataFrame:
    """The new articles of a prepared batch as rows of the target."""
    types = {f.name: f.dataType for f in target.schema.fields}
    incoming = [c for c in prepared.columns if c in types]
    defaults = _insert_defaults(now)

    def inserted(c: str) -> Column:
        if c == "id":
            value = F.col("id")
        elif c in ("created_at", "updated_at"):
            value = now
        elif c not in incoming:
            value = defaults.get(c, F.lit(None))
        elif c in _NEVER_NULL:
            value = F.coalesce(F.col(c), defaults[c])
        else:
            value = F.col(c)
        return value.cast(types[c]).alias(c)

    fresh = prepared.where(F.col("_target").isNull())
    if "id" in target.columns:
        fresh = numbered(fresh, last_id)
    return fresh.select(*[inserted(c) for c in target.columns])


def upsert_stats(target: DataFrame, batch: DataFrame) -> DataFrame:
    """One row: added, updated, skipped (earlier rows of an article that comes
    twice in the batch), errors (rows without URL or title)."""
    return count_prepared(batch, prepare_batch(batch, target))


def count_prepared(batch: DataFrame, prepared: DataFrame) -> DataFrame:
    """``upsert_stats`` for a batch that went through ``prepare_batch``."""
    totals = batch.select(
        F.lit("all").alias("kind"),
        (F.col("url").isNull() | F.col("title").isNull()).alias("bad"),
    )
    kept = prepared.select(
        F.when(F.col("_target").isNull(), "added").otherwise("updated").alias("kind"),
        F.lit(False).alias("bad"),
    )
    counted = totals.unionByName(kept).agg(
        F.count_if(F.col("kind") == "added").alias("added"),
        F.count_if(F.col("kind") == "updated").alias("updated"),
        F.count_if((F.col("kind") == "all") & ~F.col("bad")).alias("usable"),
        F.count_if("bad").alias("errors"),
    )
    return counted.select(
        "added", "updated",
        (F.col("usable") - F.col("added") - F.col("updated")).alias("skipped"),
        "errors",
    )


# ------------------------------------------------------------------ retention
def _located(df: DataFrame, steps: list[Column], wanted: Column, scope: Column) -> tuple[Column, Column]:
    """Value of the last step at the ``wanted``-th place counted from above, and
    what is still wanted there.

    Each step refines the one before; the rows of a step are counted in the
    buckets of its value, so no task holds the rows themselves.
    """
    found = None
    for bucket in steps:
        newer = F.sum("rows").over(
            Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
        )
        histogram = (
            df.where(scope).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
        )
        found = (
            histogram.withColumn("newer", F.coalesce(newer, F.lit(0)))
            .where(F.col("newer") < wanted)
            .agg(F.min_by("newer", "bucket").alias("newer"), F.min("bucket").alias("bucket"))
        )
        wanted = wanted - found.select("newer").scalar()
        scope = scope & (bucket == found.select("bucket").scalar())
    return found.select("bucket").scalar(), wanted


def _newest_first(df: DataFrame, column: str, n: int) -> tuple[Column, Column]:
    nulls = df.agg(F.count_if(F.col(column).isNull())).scalar()
    units = [F.date_trunc(unit, F.col(column)) for unit in ("day", "second", "microsecond")]
    return _located(df, units, F.lit(n) - nulls, F.col(column).isNotNull())


def nth_newest(df: DataFrame, column: str, n: int) -> DataFrame:
    """One row, ``cutoff``: the ``n``-th newest value, nulls counting as newest
    (null if the n-th is null, the oldest value if there are fewer rows).

    It is located in a histogram of days, then of seconds of that day, then of
    microseconds of that second.
    """
    cutoff, _ = _newest_first(df, column, n)
    return df.sparkSession.range(1).select(cutoff.alias("cutoff"))


def _older(df: DataFrame, n: int, column: str, tie: str | None) -> Column:
    cutoff, left = _newest_first(df, column, n)
    older = F.col(column) < cutoff
    if tie is not None:
        # the rows at the cutoff in an order of their own, by 16 bits at a time
        rank = F.xxhash64(tie)
        steps = [F.shiftright(rank, bits) for bits in (48, 32, 16, 0)]
        last, _ = _located(df, steps, left, F.col(column) == cutoff)
        older = older | ((F.col(column) == cutoff) & (rank < last))
    return F.coalesce(older, F.lit(False))


def prune_newest(
    df: DataFrame, n: int = R.MAX_ARTICLES, column: str = "generated_at", tie: str | None = None
) -> DataFrame:
    """Keep the newest ``n`` rows.  Rows as old as the n-th stay, unless a unique
    column ``tie`` tells them apart; rows without a date always stay, so more
    than ``n`` may remain."""
    return df.where(~_older(df, n, column, tie))


def prune_report(
    df: DataFrame, n: int = R.MAX_ARTICLES, column: str = "generated_at"
) -> DataFrame:
    """One row: total, kept, deleted, cutoff."""
    older = _older(df, n, column, None)
    cutoff = nth_newest(df, column, n).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~older).alias("kept"),
        F.count_if(older).alias("deleted"),
    ).withColumn("cutoff", cutoff)


# -------------------------------------------------------------------- run log
def run_entry(
    spark: SparkSession,
    source_name: str,
    started_at: datetime,
    completed_at: datetime | None,
    status: str = "success",
    error_message: str | None = None,
    **counts: int,
) -> DataFrame:
    """One run as a row of the log; the duration is in whole seconds."""
    seconds = int((completed_at - started_at).total_seconds()) if completed_at else None
    names = ("scraped", "added", "updated", "skipped", "pruned")
    row = (
        source_name, started_at, completed_at, seconds, status,
        *[int(counts.get(name, 0)) for name in names], error_message,
    )
    return spark.createDataFrame([row], SCRAPE_LOG)


def log_run(log_path: str, entry: DataFrame, run_id: int | str) -> None:
    """Store a run.  The same ``run_id`` written again replaces its entry, so a
    repeated micro-batch is counted once."""
    entry.coalesce(1).write.mode("overwrite").parquet(f"{log_path}/run_id={run_id}")


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(SCRAPE_LOG).parquet(log_path)


# --------------------------------------------------------------- stored tables
@dataclass(frozen=True)
class ParquetTable:
    """A table as a Parquet folder, partitioned by a hash bucket of ``key``.

    Spark's dynamic partition overwrite replaces the buckets a batch touches;
    the files of all others stay as they are.  Take so many ``buckets`` that one
    of them is a convenient amount to rewrite; their number belongs to the table.
    ``partition_by`` lays the files out by column as well, so that a filter on it
    prunes folders.  There is one writer at a time, and a write that is killed
    while Spark moves its files must be repeated: where that won't do, keep the
    table in a catalog with MERGE (``CatalogTable``).
    """

    spark: SparkSession
    path: str
    schema: str = ARTICLE_TABLE
    buckets: int = BUCKETS
    partition_by: tuple[str, ...] = ()
    key: str = "hash_id"

    @property
    def _fields(self) -> StructType:
        return self.spark.createDataFrame([], self.schema).schema

    def _bucket(self, key: Column) -> Column:
        return bucket_of(key, self.buckets) if self.key in self._fields.names else F.lit(0)

    def create(self) -> "ParquetTable":
        """Make the folder if there is none; refuses a table that has been
        written with another number of buckets."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
        row = self._stored().limit(1).withColumn("_expected", self._bucket(F.col(self.key)) if self.key in self._fields.names
                                                 else F.lit(0)).first()
        if row is not None and row["_bucket"] != row["_expected"]:
            raise ValueError(f"{self.path} does not have {self.buckets} buckets")
        return self

    def _stored(self) -> DataFrame:
        schema = StructType([*self._fields, StructField("_bucket", IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self, only: set[int] | None = None) -> DataFrame:
        """The table, or some buckets of it."""
        rows = self._stored()
        if only is not None:
            rows = rows.where(F.col("_bucket").isin(sorted(only)))
        return rows.select(*self._fields.names)

    def write(self, df: DataFrame, only: set[int] | None = None) -> None:
        """Replace the table, or the named buckets, by the rows of ``df``, which
        may be computed from the table itself: they are staged first."""
        fields = self._fields
        bucket = self._bucket(F.col(self.key)) if self.key in fields.names else F.lit(0)
        parts = ["_bucket", *self.partition_by]
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in fields], bucket.alias("_bucket"))
        with staging(self.spark) as stage:
            new = stage(rows.hint("rebalance", *parts), "replaced")
            folders = new.select(*parts).distinct().collect()  # at most the table's folders
            if only is not None and not {r["_bucket"] for r in folders} <= only:
                raise ValueError(f"rows of other buckets in a write of {sorted(only)}")
            before = self._stored() if only is None else self._stored().where(F.col("_bucket").isin(sorted(only)))
            gone = set(before.select(*parts).distinct().collect()) - set(folders)
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(self.path)
        for row in gone:  # folders in which nothing is left
            names = "/".join(f"{c}={_folder_value(row[c])}" for c in parts)
            discard(self.spark, f"{self.path}/{names}")

    def touched(self, keys: DataFrame) -> set[int]:
        """Buckets of the keys in the first column: at most ``buckets`` numbers."""
        own = self._bucket(F.col(keys.columns[0])).alias("b")
        return {r["b"] for r in keys.select(own).distinct().collect()}

    def merge(self, prepared: DataFrame, now: Column) -> None:
        """Upsert a batch that went through ``prepare_batch``: the buckets of its
        articles are rewritten.  A row matched by URL takes the new hash and with
        it another bucket."""
        both = F.array(F.coalesce("_target", self.key), F.coalesce(self.key, "_target"))
        touched = self.touched(prepared.select(F.explode(both)))
        if touched:
            self.write(merge_prepared(self.read(touched), prepared, now, _last_id(self.read())), touched)

    def delete(self, keys: DataFrame) -> None:
        """Delete the rows with these keys; only their buckets are rewritten."""
        touched = self.touched(keys)
        if touched:
            gone = keys.select(F.col(keys.columns[0]).alias(self.key)).distinct()
            self.write(self.read(touched).join(gone, self.key, "left_anti"), touched)


def _folder_value(value) -> str:
    """A partition value as Spark writes it into a folder's name."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    escaped = "".join(f"%{ord(c):02X}" if c in '"#%\'*/:=?\\\x7f{[]^' or ord(c) < 32 else c for c in str(value))
    return escaped


def _last_id(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if "id" in table.columns else 0


@dataclass(frozen=True)
class CatalogTable:
    """The article table in a catalog whose tables support row-level changes
    (Delta, Iceberg): the upsert is one MERGE, atomic and safe beside others."""

    spark: SparkSession
    name: str
    schema: str = ARTICLE_TABLE
    key: str = "hash_id"

    def create(self) -> "CatalogTable":
        if not self.spark.catalog.tableExists(self.name):
            self.spark.createDataFrame([], self.schema).writeTo(self.name).create()
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def merger(self, prepared: DataFrame, now: Column) -> MergeIntoWriter:
        """The MERGE of a batch that went through ``prepare_batch``; ``.merge()``
        runs it.  Matched articles take every column the batch has, new ones are
        added with defaults."""
        target = self.read()
        types = {f.name: f.dataType for f in target.schema.fields}
        taken = [c for c in prepared.columns if c in types and c not in PROTECTED]
        changed = prepared.where(F.col("_target").isNotNull()).select(
            F.col("_target"), *[F.col(c).cast(types[c]).alias(c) for c in taken],
            *[F.lit(None).cast(types[c]).alias(c) for c in target.columns if c not in taken])
        fresh = inserted_rows(target, prepared, now, _last_id(target)).withColumn("_target", F.lit(None).cast("string"))
        source = changed.unionByName(fresh).alias("batch")
        table = self.name.split(".")[-1]
        updates = {c: F.col(f"batch.{c}") for c in taken} | ({"updated_at": now} if "updated_at" in types else {})
        return (
            source.mergeInto(self.name, F.col(f"{table}.{self.key}") == F.col("batch._target"))
            .whenMatched().update(updates)
            .whenNotMatched().insert({c: F.col(f"batch.{c}") for c in target.columns})
        )

    def merge(self, prepared: DataFrame, now: Column) -> None:
        self.merger(prepared, now).merge()

    def delete(self, keys: DataFrame) -> None:
        gone = keys.select(F.col(keys.columns[0]).alias("gone")).distinct()
        table = self.name.split(".")[-1]
        gone.mergeInto(self.name, F.col(f"{table}.{self.key}") == F.col("gone")).whenMatched().delete().merge()


class Tables(NamedTuple):
    articles: ParquetTable
    sources: ParquetTable


def init_tables(spark: SparkSession, path: str) -> Tables:
    """Open the tables under ``path``; what is missing is created, and default
    sources that are not registered yet are added."""
    articles = ParquetTable(spark, f"{path}/articles").create()
    sources = ParquetTable(spark, f"{path}/sources", SOURCE, buckets=1).create()
    registered = sources.read()
    missing = default_sources(spark).join(registered.select("name"), "name", "left_anti")
    if not missing.isEmpty():
        sources.write(register_sources(registered))
    return Tables(articles, sources)


def write_raw(raw: DataFrame, path: str, stamp: datetime) -> str:
    """Dump a raw feed as JSON, one folder per run and source."""
    folder = f"{path}/{stamp:%Y%m%d_%H%M%S}"
    raw.write.partitionBy("source").json(folder)
    return folder
