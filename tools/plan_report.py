"""Physical-plan summary of every registered query.

    python tools/plan_report.py [sf_dir] > PLANS.md

Frames that several branches read are written while a plan is built (the
``written`` column counts them); the counted plan reads them back.

Counts shuffles, broadcasts, join and aggregate strategies, windows and
scans in each query's formatted plan (before AQE re-planning), and lists
the columns each Parquet scan reads.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from revlens.plans.queries import REGISTRY  # noqa: E402
from revlens import session  # noqa: E402
from revlens.session import get_session  # noqa: E402

NODES = ["Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin",
         "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Expand", "Window", "Scan parquet"]


def summarize(plan: str) -> dict:
    heads = re.findall(r"^\(\d+\) (.+?)\s*$", plan, flags=re.M)
    counts = {n: sum(1 for h in heads if h.split(" [")[0].strip().startswith(n) and
                     (n != "Exchange" or h.strip() == "Exchange")) for n in NODES}
    schemas = re.findall(r"ReadSchema: struct<(.*?)>$", plan, flags=re.M)
    return counts | {"widest_scan_cols": max((s.count(":") for s in schemas), default=0)}


def main() -> None:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf_dir = args[0] if args else "/root/testdata/sf0.1"
    spark = get_session("local[8]", shuffle_partitions=16)
    paths: list[str] = []
    make = session.scratch_path
    session.scratch_path = lambda s, name: paths.append(name) or make(s, name)
    short = {"Exchange": "shuffle", "BroadcastExchange": "bcast", "SortMergeJoin": "SMJ",
             "BroadcastHashJoin": "BHJ", "ShuffledHashJoin": "SHJ", "HashAggregate": "hashAgg",
             "SortAggregate": "sortAgg", "ObjectHashAggregate": "objAgg", "Expand": "expand",
             "Window": "window", "Scan parquet": "scans"}
    print("# Plans\n\nStatic plans (before AQE re-planning) of every registered query, from `tools/plan_report.py`. There is one plan at every")
    print("size. `written` counts frames that several branches read and that are written once while the plan is built; the other")
    print("columns are of the returned plan, which reads them back. `widest scan` is the largest number of columns of any one scan.\n")
    print(f"## {sf_dir}\n")
    print("| query | written | " + " | ".join(short[n] for n in NODES) + " | widest scan (cols) |")
    print("| --- " * (len(NODES) + 3) + "|")
    for key, fn in REGISTRY.items():
        if key == "export_mart":
            continue
        before = len(paths)
        df = fn(spark, sf_dir)
        plan = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        s = summarize(plan)
        print(f"| {key} | {len(paths) - before} | " + " | ".join(str(s[n]) for n in NODES) + f" | {s['widest_scan_cols']} |")


if __name__ == "__main__":
    main()
