"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the number of local threads. ``python bench.py all`` times every
registered query instead.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ambergrid.plans.workload import QUERIES  # noqa: E402
from ambergrid.session import build_session  # noqa: E402

HEADLINE = [
    "fraud_features",
    "user_stats",
    "time_since_last",
    "join_user_stats",
    "amount_q95",
    "alerts",
    "alert_reasons",
    "audit_report",
    "eval_auc",
    "split_stratified",
    "metric_stats",
    "run_summary",
    "ratio_features",
    "ds_latest",
    "hourly_counts",
    "stream_velocity",
    "iforest",
    "score_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = list(QUERIES) if "all" in sys.argv[1:] else HEADLINE
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    result = {
        "metric": "headline_queries_total" if names is HEADLINE else "all_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
