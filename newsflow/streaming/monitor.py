"""Run counters and health, from the run log."""

from __future__ import annotations

import threading
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from newsflow.operators.tables import log_run, run_entry

METRICS = "run"  # name of the observed metrics that RunLog reads
COUNTS = ("added", "updated", "skipped", "pruned")


def run_status(log: DataFrame) -> DataFrame:
    """Counters over all runs: articles, finished and failed runs, the last one."""
    success = F.col("status") == "success"
    last = F.struct("completed_at", "source_name")
    return log.agg(
        F.coalesce(F.sum("articles_added"), F.lit(0)).alias("articles_generated"),
        F.coalesce(F.sum("articles_pruned"), F.lit(0)).alias("articles_pruned"),
        F.count_if(success).alias("scrapes_completed"),
        F.count_if(F.col("status") == "failed").alias("scrapes_failed"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.min("started_at").alias("started_at"),
        F.max("completed_at").alias("last_tick_at"),
        F.max(F.when(success, last)).alias("_last"),
    ).select(
        "articles_generated", "articles_pruned", "scrapes_completed", "scrapes_failed",
        "running", "started_at", "last_tick_at",
        F.col("_last.completed_at").alias("last_scrape_at"),
        F.col("_last.source_name").alias("last_source_scraped"),
    )


def source_health(log: DataFrame, waiting: DataFrame | None = None) -> DataFrame:
    """Health per source.

    A source without a running entry is ``stopped``.  An empty queue after at
    least one finished run, or more failed than finished runs, makes it
    ``degraded``, which overrides ``stopped``.  ``waiting`` has one row per
    unread input with its ``source_name``.
    """
    runs = log.groupBy("source_name").agg(
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if(F.col("status") == "success").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    if waiting is None:
        runs = runs.withColumn("queue_size", F.lit(0).cast("bigint"))
    else:
        queue = waiting.groupBy("source_name").agg(F.count(F.lit(1)).alias("queue_size"))
        runs = runs.join(queue, "source_name", "left").fillna(0, ["queue_size"])
    stopped = F.col("running") == 0
    empty = (F.col("queue_size") == 0) & (F.col("completed") > 0)
    failing = (F.col("failed") > F.col("completed")) & (F.col("completed") > 0)
    issues = F.array_compact(
        F.array(
            F.when(stopped, "Pipeline is not running"),
            F.when(empty, "Article queue is empty"),
            F.when(failing, "More scrapes failing than succeeding"),
        )
    )
    return runs.select(
        "source_name",
        F.when(empty | failing, "degraded").when(stopped, "stopped").otherwise("healthy").alias(
            "status"
        ),
        issues.alias("issues"),
        "running", "completed", "failed", "queue_size",
    )


def stream_progress(query: StreamingQuery) -> dict:
    """State of a running ingestion."""
    progress = query.lastProgress
    return {
        "is_running": query.isActive,
        "batch_id": progress.batchId if progress else None,
        "rows": progress.numInputRows if progress else 0,
    }


class RunLog(StreamingQueryListener):
    """Writes the run log from a stream's own events, so ``run_status`` and
    ``source_health`` hold while it runs.

    A started query is one ``running`` entry, which its end turns into
    ``stopped``, or ``failed`` with the error.  Every batch that read something
    is one ``success`` entry: its time and rows come from the progress, its
    counts from the metrics that the stream observes under the name ``METRICS``
    (``df.observe(METRICS, F.count_if(...).alias("added"))``), so nothing is
    counted in a job of its own.  ``name`` restricts the log to one query name.
    """

    def __init__(self, spark: SparkSession, log_path: str, source: str, name: str | None = None):
        self.spark, self.log_path, self.source, self.name = spark, log_path, source, name
        self.started: dict[str, datetime] = {}
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        if self.name in (None, event.name):
            self.started[str(event.runId)] = now = datetime.now(timezone.utc)
            log_run(self.log_path, run_entry(self.spark, self.source, now, None, "running"), str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if str(progress.runId) not in self.started or not progress.numInputRows:
            return
        start = datetime.fromisoformat(progress.timestamp)
        end = start + timedelta(milliseconds=progress.durationMs.get("triggerExecution", 0))
        metrics = progress.observedMetrics.get(METRICS)
        counts = {k: v for k, v in (metrics.asDict() if metrics else {}).items() if k in COUNTS}
        entry = run_entry(self.spark, self.source, start, end, scraped=progress.numInputRows, **counts)
        log_run(self.log_path, entry, f"{progress.runId}-{progress.batchId}")

    def onQueryTerminated(self, event) -> None:
        start = self.started.pop(str(event.runId), None)
        if start is not None:
            status = "failed" if event.exception else "stopped"
            entry = run_entry(self.spark, self.source, start, datetime.now(timezone.utc), status, event.exception)
            log_run(self.log_path, entry, str(event.runId))
            self.ended.set()
