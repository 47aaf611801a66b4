"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.  Each
query runs once to warm up and then three times; its figure is the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardlight.plans.driver_queries import QUERIES  # noqa: E402
from wardlight.session import build_session  # noqa: E402

HEADLINE = [
    "monthly_evolution", "stalled_at_step", "step_wait", "top_k_by_count", "latest_pivot", "aging",
    "period_indicators", "monthly_count_joined", "monthly_count_two_key", "single_event_queue", "frequent_returners",
    "mean_duration_hm", "mean_stay_by_group", "count_by_age_band", "keyword_class_monthly", "prescription_detail",
    "ordered_list", "hourly_arrivals", "encounter_summary", "metric_table", "link_alert_metric", "cross_findings",
]


def run(df: DataFrame) -> None:
    """Compute every row and column without bringing them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false",
            "spark.log.level": "ERROR",
        },
    )
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    times = {}
    for name in names:
        seconds = []
        for _ in range(4):
            start = time.perf_counter()
            run(QUERIES[name](spark, folder))
            seconds.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seconds[1:]), 3)
    print(json.dumps({
        "metric": "headline queries, total of medians", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
