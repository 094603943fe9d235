"""Times the headline queries; prints one JSON line.

Each query is built and run ``BENCH_RUNS`` + 1 times; the best run counts, so
times are those of a warm JVM, planning included.  Results go to the ``noop``
sink: every row is computed and nothing is collected.

The read queries (feed, trending, insights, counts, upsert) scan the stored
article table.  Filling it is timed as ``article_table`` and is not part of
their own best run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from newsflow.session import get_spark  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = [
    "clean_pages", "clean_articles", "cleaning_report", "url_dedup", "title_dedup", "normalize_text",
    "standardize_dates", "categorize", "categorize_corpus_rules",
    "keywords", "sentiment", "entities",
    "article_table", "page_main_text", "enrich_feed_content", "stories", "rss_items", "article_cards",
    "json_posts", "union_feeds", "article_feed", "trending", "insights", "top_keywords",
    "stats_by_source", "confidence_by_category", "upsert_articles", "prune_newest_many",
    "interleave_sources", "run_status", "paragraphs",
]


def main() -> None:
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    spark = get_spark(
        "bench", f"local[{CPUS}]",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=CPUS, spark__driver__memory="16g",
        newsflow__view__partitions=str(2 * int(CPUS)),  # the test tables are single row groups
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs, chars = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr(
        "count(*)", "sum(length(text))"
    ).first()
    times = {}
    for name in names:
        best = None
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    analytics = ("categorize", "keywords", "sentiment", "article_table")
    rates = {f"{n}_docs_per_sec": round(docs / times[n]) for n in analytics if n in times}
    rates |= {f"{n}_chars_per_sec": round(chars / times[n]) for n in analytics if n in times}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS),
        "documents": docs, "rates": rates,
    }))


if __name__ == "__main__":
    main()
