"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 4) the local cores.
Each query runs once to warm up and three times measured; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "t01_leaderboard",
    "scoring_run",
    "w01_rank_scores",
    "p01_classify",
    "a01_reputable_share",
    "a04_window_sums",
    "j09_nearest_returns",
    "i02_bars_from_ticks",
    "w16_composite_top_share",
    "a11_event_study",
    "a12b_trade_summary_hourly",
    "x04_factor_table",
    "s13_keyed_upsert",
    "i01_closed_bars_stream",
]


def main() -> None:
    from crosstide.plans.catalog import QUERIES
    from crosstide.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session("bench", cpus, max(8, 2 * cpus))
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        runs = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    line = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf, "cpus": cpus}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
