"""Benchmark the headline reports.

Runs each query over $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Each query is fully executed into Spark's ``noop`` sink (no collect to the
driver); the time per query is the median of $BENCH_REPEAT (default 3) runs after
one warm-up query.  Every run lists the files and builds its plan anew.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revlens.plans.queries import REGISTRY  # noqa: E402
from revlens.session import get_session  # noqa: E402

HEADLINE = [
    "first_touch_by_channel", "last_touch_by_channel", "linear_by_channel",
    "first_touch_by_month", "last_touch_by_month", "linear_by_month",
    "attribution_by_utm_medium", "attribution_by_utm_campaign", "order_touches", "qa_untouched",
    "opp_influence", "pipeline_influence", "customer_influence",
    "lead_funnel", "funnel_by_month", "overview_by_month",
    "overall_cac", "ltv_by_abm", "ltv_by_industry", "ltv_by_segment", "overall_ltv",
    "spend_vs_attribution",
    "stage_contacts", "stage_leads", "stage_accounts", "dup_keys", "dedup_preview",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = get_session(f"local[{cpus}]", app="revlens-bench", shuffle_partitions=2 * cpus,
                        extra={"spark.driver.memory": "8g"})
    _run(REGISTRY["first_touch_by_channel"](spark, sf_dir))  # warm-up (JIT, file listing)
    times: dict[str, float] = {}
    for key in HEADLINE:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            _run(REGISTRY[key](spark, sf_dir))
            runs.append(time.perf_counter() - t0)
        times[key] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_reports_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
