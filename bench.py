"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads. Each query is run once to warm up
and then twice; the better time counts. Results go to a sink that reads every row.
"""

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from roadpulse.plans.queries import all_queries  # noqa: E402
from roadpulse.session import build_session  # noqa: E402

HEADLINE = [
    "validate",
    "dedup_in_batch",
    "canonicalize",
    "processing_outcomes",
    "decode_telemetry",
    "normalize_ingest",
    "parse_canonical",
    "write_canonical",
    "authorize_events",
    "route_events",
    "two_stage_feed",
    "unrouted_events",
    "conflate",
    "pod_interest",
    "interest_versions",
    "check_access",
    "latest_positions",
    "fleet_board",
    "merge_newest",
    "read_history",
    "history_outcomes",
    "update_rate",
    "latency_histogram",
    "fleet_map_changes",
    "upsert_vehicles",
    "apply_grants",
    "master_data_violations",
]
STREAMS = ["canonical_stream", "history_stream", "latest_state_stream", "live_feed_stream"]


def timed(make, spark, sf_dir) -> float:
    start = time.perf_counter()
    make(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        f"local[{cpus}]",
        "roadpulse-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='roadpulse-bench-')}",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    for name in HEADLINE:
        timed(queries[name], spark, sf_dir)
        times[name] = round(min(timed(queries[name], spark, sf_dir) for _ in range(2)), 3)
    for name in STREAMS:
        times[name] = round(timed(queries[name], spark, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "sum of headline query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
