"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``first_run`` is the flagship in a new session, ``queries`` are single runs after it, ``warm`` is the median of three
further runs of the three rated queries, ``more`` is not part of the total. ``moved`` has the MB that each query
wrote to shuffles and spilled, from Spark's event log.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logmill.plans.synth import log_corpus  # noqa: E402
from logmill.queries import QUERIES  # noqa: E402

HEADLINES = (
    "prepared_summary", "prepared_batches", "document_summary", "page_batches", "log_events",
    "broker_events", "journal_events", "broker_blocks", "corpus_templates", "line_severity",
    "sanitized_text", "request_responses", "audit_verdicts", "history_within_budget",
    "priority_lines", "stream_lines", "stream_windows",
)
RATED = ("prepared_summary", "prepared_batches", "log_events")
MORE = ("line_summary", "stream_sessions", "stream_blocks")


def session(cpus: str, events: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("logmill-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="logmill-bench-"))
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", f"file://{events}")
        .config("spark.eventLog.compress", "false")
        .config("spark.eventLog.rolling.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def moved(events: str, spans: dict[str, tuple[float, float]]) -> dict[str, list[float]]:
    """MB written to shuffles and spilled by the tasks that ended while each query ran."""
    found = {name: [0.0, 0.0] for name in spans}
    for path in Path(events).iterdir():
        for line in path.open():
            if '"SparkListenerTaskEnd"' not in line:
                continue
            event = json.loads(line)
            at, metrics = event["Task Info"]["Finish Time"] / 1000, event.get("Task Metrics") or {}
            for name, (start, end) in spans.items():
                if start <= at <= end:
                    found[name][0] += metrics.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0) / 1e6
                    found[name][1] += metrics.get("Disk Bytes Spilled", 0) / 1e6
    return {name: [round(x, 2) for x in pair] for name, pair in found.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINES
    events = tempfile.mkdtemp(prefix="logmill-bench-events-")
    spark = session(os.environ.get("BENCH_CPUS", "8"), events)
    # the first use of a session compiles code; it is not what a query costs
    first = run(spark, names[0], sf_dir)
    spans: dict[str, tuple[float, float]] = {}

    def timed(name: str) -> float:
        start = time.time()
        took = run(spark, name, sf_dir)
        spans[name] = (start, time.time())
        return round(took, 3)

    timings = {name: timed(name) for name in names}
    more = {name: timed(name) for name in MORE} if names is HEADLINES else {}
    warm = {name: round(median(run(spark, name, sf_dir) for _ in range(3)), 3) for name in RATED if name in timings}
    size = log_corpus(spark, sf_dir).selectExpr("sum(octet_length(text)) / 1e6").first()[0]
    count = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rates = {
        name: {"mb_per_sec": round(size / took, 2), "events_per_sec": round(count / took)} for name, took in warm.items()
    }
    spark.stop()
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "first_run": round(first, 3), "warm": warm, "more": more, "rates": rates,
        "moved": moved(events, spans), "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
