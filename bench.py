"""Times the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, or "all").
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from txnrisk import queries as registry
from txnrisk.session import local_session

HEADLINE = [
    "time_since_last",
    "travel_features",
    "velocity",
    "amount_deviation_30d",
    "inter_arrival_entropy",
    "card_period_stats",
    "merchant_zscore",
    "login_features",
    "feature_table",
    "rule_statistics",
    "tier_coverage",
    "hourly_rollup",
    "amount_summary",
    "label_correlation",
    "encoded_categories",
    "pr_curve",
    "evaluation_report",
    "stream_velocity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    known = registry.queries()
    names = list(known) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    known["class_balance"](spark, sf_dir).collect()  # start-up is not part of any query
    times = {}
    for name in names:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    result = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
