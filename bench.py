"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
local cores, BENCH_RUNS (default 3) the warm runs per query; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lotgrain.plans.table_queries import QUERIES  # noqa: E402
from lotgrain.session import build_session  # noqa: E402

HEADLINE = [
    "group_summary", "group_members", "group_rows", "group_image", "makes_models",
    "facet_conjunction", "exclude_make_model", "filter_all_of",
    "number_cleanup", "url_params", "page_links", "page_counter", "result_page_ads", "ad_page_listings",
    "new_ads", "known_ads", "merge_short_detail", "upsert_latest", "refresh_update", "listing_lifetimes",
    "run_stats", "stream_ingest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "lotgrain-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=cpus,
        extra={
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)
        repeats = 1 if name.startswith("stream") else runs
        seconds[name] = round(statistics.median(once(name) for _ in range(repeats)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
