"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from checks.compare import session
from checks.registry import queries
from logfathom.operators import cluster, parse
from logfathom.plans.scale import delete_path, work_path
from logfathom.sources import logs, tables
from logfathom.streaming import queries as queries_of_streams

LAYOUTS = ("logfmt", "bracket", "json", "container")
COPIES = 10

HEADLINES = [
    "detect_format", "parse_logfmt", "parse_bracket", "parse_simple", "parse_json", "parse_docker",
    "parse_all", "search_logs", "filter_logs", "history", "fingerprint_docs", "patterns", "variants",
    "top_patterns", "variant_times", "pattern_times", "inspect", "recent_summary", "level_counts",
    "last_seen", "heartbeat", "snapshot", "situation_report", "ticks", "trend", "rolling_rate",
    "running_peak", "spike_candidates", "incidents", "incident_context", "incident_reports",
    "throttle", "alerts", "state_merge", "clean_line",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(action) -> float:
    began = time.perf_counter()
    action()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    warm = tables.raw_lines(spark, sf_dir, "mixed")
    run(cluster.patterns(parse.parse_logs(warm)))  # compiles and starts what later runs share
    registry = queries()
    times = {name: seconds(lambda: run(registry[name](spark, sf_dir)))
             for name in sys.argv[1:] or HEADLINES}

    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "lines_per_sec": sustained(spark, sf_dir)}))
    spark.stop()


def sustained(spark, sf_dir: str) -> dict[str, int]:
    """Lines per second from text files through detection, parsing and clustering, by layout, and
    of a stream that counts them. The files hold the lines of the table ten times over."""
    rates = {}
    for layout in LAYOUTS:
        path = work_path(spark, "bench")
        lines = tables.raw_lines(spark, sf_dir, layout).withColumn(
            "copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
        lines.select("source", F.col("line").alias("value")).write.partitionBy("source").text(path)
        count = spark.read.text(path).count()

        def through() -> None:
            formats = logs.detect_sources(spark, f"{path}/*", logs.source_folder)
            raw = logs.read_logs(spark, f"{path}/*").withColumn("source", logs.source_folder())
            run(cluster.patterns(parse.parse_logs(raw, formats)))

        rates[layout] = round(count / seconds(through))
        if layout == "logfmt":
            out = work_path(spark, "bench-stream")
            events = queries_of_streams.stream_events(spark, f"{path}/*", source=logs.source_folder)
            rates["stream"] = round(count / seconds(lambda: queries_of_streams.start_counts(
                events, out, f"{out}-checkpoint").awaitTermination()))
        delete_path(spark, path)
    return rates


if __name__ == "__main__":
    main()
