"""Time the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Batch queries run to a sink that discards rows: once to warm up, then three times, and the median
counts. Queries that run a stream or write tables do their work while they are built; they run once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from checks import logs
from checks.queries import QUERIES
from tidemark.session import build_session, scratch_folder
from tidemark.sources.changes import saved_messages
from tidemark.streaming import ingest

WRITING = {
    "late_event_order",
    "history_append_count",
    "batch_run_orders",
    "export_reports",
    "stream_current_orders",
    "stream_fanout_counts",
    "stream_mart_orders_by_date_status",
    "stream_marts",
    "stored_orders_merged_twice",
    "stream_replay_idempotent",
}


def run(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def stream_figures(spark, sf_dir: str) -> dict[str, float]:
    """How fast a micro-batch holding everything is landed, how long the first refresh of the marts takes then, and how long one
    after a micro-batch with a hundredth of the messages again."""
    feed = scratch_folder(spark, "bench-feed")
    logs.save_messages(logs.all_messages(spark, sf_dir), feed)
    messages = saved_messages(spark, feed)
    count = messages.count()
    landed, refreshed, again = [], [], []
    for _ in range(3):
        root = scratch_folder(spark, "bench-out")
        started = time.perf_counter()
        ingest.land(spark, messages, 0, root)
        landed.append(time.perf_counter() - started)
        started = time.perf_counter()
        ingest.refresh_marts(spark, root, 0)
        refreshed.append(time.perf_counter() - started)
        ingest.upkeep(spark, root)
        ingest.land(spark, messages.filter("pmod(hash(value), 100) = 0"), 1, root)
        started = time.perf_counter()
        ingest.refresh_marts(spark, root, 1)
        again.append(time.perf_counter() - started)
    return {
        "messages_per_sec": round(count / statistics.median(landed)),
        "mart_refresh_sec": round(statistics.median(refreshed), 3),
        "mart_refresh_of_a_hundredth_sec": round(statistics.median(again), 3),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(QUERIES)
    times: dict[str, float] = {}
    for name in names:
        if name in WRITING:
            times[name] = run(QUERIES[name], spark, sf_dir)
        else:
            run(QUERIES[name], spark, sf_dir)
            times[name] = statistics.median(run(QUERIES[name], spark, sf_dir) for _ in range(3))
        print(f"{name} {times[name]:.2f}", file=sys.stderr, flush=True)
    figures = {} if sys.argv[1:] else stream_figures(spark, sf_dir)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {name: round(t, 3) for name, t in times.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                **figures,
            }
        )
    )


if __name__ == "__main__":
    main()
