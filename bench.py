"""Headline timings: prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Every query is run once
unmeasured and then once measured, into a sink that computes all rows and columns.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyward.catalog import registered  # noqa: E402
from tallyward.session import build_session  # noqa: E402

HEADLINE = [
    "dedupe_latest", "silver_incidents", "silver_located", "pip_join", "daily_summary", "star_rollup",
    "star_rollup_orders", "area_daily", "area_features_backfill", "horizon_expand", "score_batch", "drift", "snapshot",
    "graph_edges", "textlog_guardrails", "citations", "stream_daily",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog = registered()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            catalog[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
