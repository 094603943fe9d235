"""Batch runs: clean, stamp, upsert, prune; and the balanced sample."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.operators.cleaning import ORD, to_records
from newsflow.operators.joins import resolve_source
from newsflow.operators.tables import (
    CatalogTable,
    ParquetTable,
    count_prepared,
    log_run,
    prepare_batch,
    prune_newest,
    run_entry,
)
from newsflow.plans.clean import clean_articles
from newsflow.session import staging


def prepare_records(
    raw: DataFrame, stamp: Column, overwrite_scraped: bool = False, **options
) -> DataFrame:
    """Clean a raw feed into table records with one generation time."""
    records = to_records(clean_articles(raw, **options)).withColumn("generated_at", stamp)
    return records.withColumn("scraped_at", stamp) if overwrite_scraped else records


def run_batch(
    source: str,
    raw: DataFrame,
    table: ParquetTable | CatalogTable,
    sources: DataFrame | None = None,
    log_path: str | None = None,
    run_id: int | str | None = None,
    max_articles: int | None = None,
    overwrite_scraped: bool = False,
    now: datetime | None = None,
) -> dict:
    """Ingest one feed and return its counts.

    The raw feed, the cleaned batch and its match against the table are written
    once and read back, so nothing is parsed or cleaned twice and a lost
    executor costs only its own tasks; they are deleted at the end.  Only the
    table's buckets that the batch touches are rewritten, or it is one MERGE in a
    catalog that has it.

    ``max_articles`` asks for retention: only so many articles stay, the newest
    generated ones.  All articles of a run have one generation time; among them
    the hash decides.
    """
    started = datetime.now(timezone.utc)
    stamp = F.lit(now or started)
    table.create()
    with staging(table.spark) as stage:
        feed = stage(raw, "raw")
        records = stage(prepare_records(feed, stamp, overwrite_scraped), "batch")
        if sources is not None:
            records = resolve_source(records, sources)
        prepared = stage(prepare_batch(records, table.read()), "prepared")
        counts = count_prepared(records, prepared).first().asDict()
        table.merge(prepared, stamp)
        pruned = 0 if max_articles is None else prune_table(table, max_articles)
        result = {"source": source, "scraped": feed.count(), **counts, "pruned": pruned}
    if log_path is not None:
        entry = run_entry(
            table.spark, source, started, datetime.now(timezone.utc),
            scraped=result["scraped"], added=counts["added"], updated=counts["updated"],
            skipped=counts["skipped"], pruned=pruned,
        )
        log_run(log_path, entry, run_id if run_id is not None else started.strftime("%Y%m%d%H%M%S%f"))
    return result


def prune_table(table: ParquetTable | CatalogTable, n: int) -> int:
    """Keep the newest ``n`` articles of a table; the number deleted.  The
    cutoff comes from two narrow columns, and only buckets that lose rows are
    rewritten."""
    rows = table.read().select("hash_id", "generated_at").where(F.col("hash_id").isNotNull())
    with staging(table.spark) as stage:
        kept = prune_newest(rows, n, tie="hash_id")
        gone = stage(rows.join(kept.select("hash_id"), "hash_id", "left_anti").select("hash_id"), "pruned")
        number = gone.count()
        if number:
            table.delete(gone)
        return number


def run_one(feeds: Mapping[str, DataFrame], source: str, table: ParquetTable | CatalogTable, **options) -> dict:
    """Ingest the named feed; an unknown name is an error entry, as is a failure."""
    if source not in feeds:
        return {"error": f"no feed named {source!r}"}
    try:
        return run_batch(source, feeds[source], table, **options)
    except Exception as error:  # a failing feed must not stop the others
        return {"source": source, "error": str(error)}


def run_all(feeds: Mapping[str, DataFrame], table: ParquetTable | CatalogTable, **options) -> list[dict]:
    """Ingest all feeds in order."""
    return [run_one(feeds, source, table, **options) for source in feeds]


def interleave_sources(
    df: DataFrame,
    per_source: int = 10,
    seed: str = "0",
    source: str = "source",
    key: str = ORD,
) -> DataFrame:
    """Up to ``per_source`` articles of every source in a repeatable shuffled
    order, dealt round robin (``turn``).

    The rank limit is applied in each task before the shuffle, so a source with
    a third of all rows sends ``per_source`` rows per task.
    """
    order = F.sha2(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")), 256)
    ranked = df.withColumn("_shuffle", order).withColumn(
        "turn", F.row_number().over(Window.partitionBy(source).orderBy("_shuffle", key))
    )
    return ranked.where(F.col("turn") <= per_source).drop("_shuffle").orderBy("turn", source)
