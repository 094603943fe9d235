"""Continuous ingestion with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType, VariantType

from newsflow import rules as R
from newsflow.functions.urls import hash_id
from newsflow.operators.tables import CatalogTable, ParquetTable, log_run, run_entry
from newsflow.plans.batch import run_batch
from newsflow.schemas import STORY
from newsflow.session import staging
from newsflow.sources.stories import parse_stories
from newsflow.streaming.state import FirstSighting

Parser = Callable[[DataFrame], DataFrame]
CORRUPT = "_corrupt"  # what can't be read as an item
HALVINGS = 24  # of a failing batch, to find the items that fail
FAILURES = 20  # parts of a batch that may fail by themselves; more than that isn't the items' fault
BUCKETS = 1024  # of the articles a stream has let through; more for many millions
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest_batch(
    rows: DataFrame,
    batch_id: int,
    source: str,
    table: ParquetTable | CatalogTable,
    parse: Parser,
    log_path: str,
    sources: DataFrame | None = None,
    max_articles: int | None = None,
    skip_failed: bool = False,
) -> dict:
    """One micro-batch: parse, clean, stamp (the scrape date too), upsert, prune, log.

    A repeated batch finds its articles in the table and updates them to the
    same content; its log entry replaces the earlier one.  A batch that fails is
    logged as failed and stops the stream, which takes it up again when it is
    restarted; ``skip_failed`` goes on without it instead.
    """
    try:
        return run_batch(
            source, parse(rows), table, sources=sources, log_path=log_path, run_id=batch_id,
            max_articles=max_articles, overwrite_scraped=True,
        )
    except Exception as error:
        now = datetime.now(timezone.utc)
        entry = run_entry(table.spark, source, now, now, "failed", str(error))
        log_run(log_path, entry, batch_id)
        if not skip_failed:
            raise
        return {"source": source, "error": str(error)}


def quarantine_rows(rows: DataFrame, path: str, name: str, source: str, reason: str) -> None:
    """Keep items that can't be ingested, as JSON, with the reason.  The same
    part of a batch written again replaces its entry."""
    columns = [c for c in rows.columns if c != CORRUPT]
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))
    payload = F.coalesce(F.col(CORRUPT), whole) if CORRUPT in rows.columns else whole
    rows.select(F.lit(source).alias("source"), payload.alias("payload"), F.lit(reason).alias("reason")).write.mode(
        "overwrite").parquet(f"{path}/part={name}")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source string, payload string, reason string").parquet(path).select(
        "source", "payload", "reason")


def ingest_items(rows: DataFrame, batch_id: int, source: str, table: ParquetTable | CatalogTable, parse: Parser,
                 log_path: str, quarantine: str, **options) -> list[dict]:
    """``ingest_batch`` in which one bad item stops nothing.

    What couldn't be read goes to the quarantine at once.  A batch that fails is
    halved by a hash of its items until the failing ones stand alone; they are
    quarantined with their error and all others are ingested.  When more than
    ``FAILURES`` parts fail by themselves, the batch fails.
    """
    failed: list[str] = []

    def work(part: DataFrame, depth: int, bits: int) -> list[dict]:
        name = f"{batch_id}" if depth == 0 else f"{batch_id}-{depth}-{bits}"
        try:
            return [run_batch(source, parse(part), table, log_path=log_path, run_id=name, overwrite_scraped=True, **options)]
        except Exception as error:
            if depth == HALVINGS or part.limit(2).count() < 2:
                failed.append(name)
                if len(failed) > FAILURES:
                    raise
                quarantine_rows(part, quarantine, name, source, str(error).split("JVM stacktrace")[0].strip())
                return []
        hashed = F.xxhash64(*[F.col(f"`{c}`") for c in part.columns])
        done = []
        for bit in (0, 1):
            half = part.where(F.shiftright(hashed, depth).bitwiseAND(F.lit(1)) == bit)
            if not half.isEmpty():
                done += work(half, depth + 1, bits << 1 | bit)
        return done

    with staging(table.spark) as stage:
        items = stage(rows, "items")
        if CORRUPT in items.columns:
            broken = items.where(F.col(CORRUPT).isNotNull())
            if not broken.isEmpty():
                quarantine_rows(broken, quarantine, f"{batch_id}-unread", source, "not an item")
            items = items.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        return work(items, 0, 0)


def stream_ingest(
    spark: SparkSession,
    source_dir: str,
    table: ParquetTable | CatalogTable,
    checkpoint: str,
    log_path: str,
    source: str = "hackernews",
    schema: str = STORY,
    parse: Parser = parse_stories,
    max_files: int = 10,
    interval: str | None = None,
    max_articles: int | None = None,
    sources: DataFrame | None = None,
    skip_failed: bool = False,
    quarantine: str | None = None,
) -> StreamingQuery:
    """Watch a folder of JSON files and keep the article table up to date.

    With a ``quarantine`` folder, lines that are no items and items that can't be
    ingested are kept there with their reason and the rest goes on (see
    ``ingest_items``); without, such lines are dropped and a failing batch stops
    the stream.

    ``interval`` runs for ever in that rhythm; without it everything present is
    ingested in bounded batches and the query ends.  Each trigger reads at most
    ``max_files`` files, so the batch size is bounded however large the backlog.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    if quarantine:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
        schema = f"{schema}, {CORRUPT} STRING"
    rows = reader.schema(schema).json(source_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        if quarantine:
            ingest_items(batch, batch_id, source, table, parse, log_path, quarantine,
                         sources=sources, max_articles=max_articles)
            return
        ingest_batch(
            batch, batch_id, source, table, parse, log_path, sources, max_articles, skip_failed
        )

    writer: DataStreamWriter = rows.writeStream.foreachBatch(each).option(
        "checkpointLocation", checkpoint
    )
    if interval:
        return writer.trigger(processingTime=interval).start()
    return writer.trigger(availableNow=True).start()


def stream_dedup(articles: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """Drop repeated articles in a stream with bounded state.

    Unlike the table upsert, which compares with everything stored, a repeat is
    only seen within ``delay`` of the first one.
    """
    return (
        articles.withColumn("hash_id", hash_id(F.col("url"), R.HASH_ID_CHARS))
        .withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(["hash_id"])
    )


def stream_unique(
    articles: DataFrame, event_time: str, lifetime: str = "7 days", delay: str = "1 day", buckets: int = BUCKETS,
) -> DataFrame:
    """Each article once in ``lifetime``, across all ticks of a stream.

    A sighting passes if none of the same article -- by the hash of its URL --
    passed less than ``lifetime`` before it; the sightings of one tick go in
    order of event time, equal ones in order of a hash.  The state holds one
    number for each article, which goes when the watermark, ``delay`` behind the
    newest event, has passed its lifetime: until then later sightings are
    compared exactly, after it none can come that isn't late.  Late rows are
    dropped.  Rows without URL or time are nobody's repeat and pass.  Variant
    columns travel as JSON.  Needs the RocksDB state store, which is set for the
    session.

    Articles lie in ``buckets`` by a hash, each with one state and one timer, so
    a tick calls the state store for each bucket it touches, not for each article;
    it reads the whole state of these buckets, and a task holds the rows of one
    at a time.  The number stays as it is for the life of a checkpoint.
    """
    spark = articles.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    variants = [f.name for f in articles.schema if isinstance(f.dataType, VariantType)]
    rows = articles.withColumns({c: F.to_json(c) for c in variants})
    schema = StructType([f for f in rows.schema])
    names = rows.columns
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    key = F.coalesce(hash_id(F.col("url"), R.HASH_ID_CHARS), F.concat(F.lit("row "), tie.cast("string")))
    millions = spark.range(1).select(F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.expr(f"INTERVAL {lifetime}"))
                                     - F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp"))).first()[0]
    keyed = rows.withColumns({
        "_article": key, "_us": F.unix_micros(event_time), "_tie": tie,
    }).withColumn("_bucket", F.pmod(F.xxhash64("_article"), F.lit(buckets)).cast("int")).withWatermark(event_time, delay)
    out = keyed.groupBy("_bucket").transformWithState(FirstSighting(names, millions), schema, "append", "eventTime")
    return out.withColumns({c: F.parse_json(c) for c in variants}).select(*articles.columns)
