"""The sources dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow import rules as R
from newsflow.schemas import SOURCE

SCRAPE_FREQUENCY_HOURS = 6


def default_sources(spark: SparkSession, sources=R.DEFAULT_SOURCES) -> DataFrame:
    return spark.createDataFrame(
        [(i, *s, True, SCRAPE_FREQUENCY_HOURS) for i, s in enumerate(sources, start=1)], SOURCE
    )


def register_sources(existing: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Add the wanted sources whose name is not registered yet.

    New ids follow the largest id in use.  The dimension holds one row per
    feed, so numbering it is a small job.
    """
    wanted = default_sources(existing.sparkSession) if wanted is None else wanted
    new = wanted.join(existing.select("name"), "name", "left_anti")
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = new.withColumn("id", (last + F.col("id")).cast("int"))
    return existing.unionByName(numbered.select(*existing.columns))


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.select("id", "name", "display_name", "url", "is_active")
