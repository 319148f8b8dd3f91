"""Times every query over one folder of tables and prints one JSON line.

BENCH_SF_DIR   folder of parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_RUNS     timed runs per query, the median counts (default 1)
BENCH_QUERIES  comma-separated names, or "all" (default: the question bank and one query for
               every other kind of plan)

The session has the settings that users of the package get (``votecount.session``) and no others
that change plans. Rows are computed and thrown away inside the executors, so no result passes the driver.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from votecount.registry import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
HEADLINE = [n for n in QUERIES if n.startswith("q")] + [
    "src_transcriptions",
    "file_inventory",
    "insert_if_absent",
    "official_by_municipality",
    "winner_by_department",
    "event_replay",
    "latest_state",
    "stats_snapshot",
    "official_rejects",
    "decide_state",
    "inconsistencies_all",
    "first_sheet_wins",
    "parse_sms",
    "sms_register",
    "parse_embedded_text",
    "parse_ocr_text",
    "upload_outcomes",
    "merge_visual_flags",
    "turnout_outliers",
]


def chosen() -> list[str]:
    asked = os.environ.get("BENCH_QUERIES", "")
    if asked == "all":
        return list(QUERIES)
    return [n for n in asked.split(",") if n] or HEADLINE


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("votecount-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        # Plans are built from many small calls; do not look up the caller for each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def run(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    for name in ("q03_votes_by_department", "sms_register"):
        run(spark, name)
    seconds = {}
    for name in chosen():
        seconds[name] = round(statistics.median(run(spark, name) for _ in range(RUNS)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
