"""Summarise the physical plan of every registered query into PLANS.md.

For each query: the scans (table, pushed filters, columns read), join
strategies, shuffles, partial aggregates and Python steps, taken from the
executed (AQE-final) plan after one run.

Usage: python scripts/plan_report.py [sf_dir] [out.md]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skywatch.plans.queries import QUERIES  # noqa: E402
from skywatch.session import get_spark  # noqa: E402

STREAMING = {"login_stream", "login_messages", "device_stream"}
JOINS = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct"]


def summarise(plan: str) -> dict:
    scans = []
    for m in re.finditer(r"FileScan parquet ([^\[]*)\[[^\]]*\] .*?Location: \w+\([^)]*\)\[([^\]]*)\]"
                         r".*?PushedFilters: \[([^\]]*)\].*?ReadSchema: struct<([^>]*)>", plan):
        path = m.group(2).split(",")[0].rstrip("/").split("/")[-1]
        cols = len(re.findall(r"[^,<]+:[^,]+", m.group(4)))
        scans.append((path, m.group(3)[:90] or "-", cols))
    return {
        "scans": scans,
        "joins": {j: plan.count(j + " ") + plan.count(j + "(") for j in JOINS if j in plan},
        "shuffles": plan.count("Exchange hashpartitioning") + plan.count("Exchange RoundRobin")
        + plan.count("Exchange rangepartitioning") + plan.count("Exchange SinglePartition"),
        "partial_aggs": len(re.findall(r"partial_\w+", plan)),
        "python": plan.count("ArrowEvalPython") + plan.count("BatchEvalPython"),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out = sys.argv[2] if len(sys.argv) > 2 else os.path.join(os.path.dirname(os.path.dirname(
        os.path.abspath(__file__))), "PLANS.md")
    spark = get_spark("local[8]", 16)
    lines = ["# Physical plans of the registered queries", "",
             f"Generated by `scripts/plan_report.py` on `{sf_dir}` after one run (AQE final plans).",
             "Scans list `table: pushed filters (columns read)`; a scan of a table written by",
             "`materialize` shows its scratch name.", "",
             "| query | scans | joins | shuffles | partial aggs | python |", "|---|---|---|---|---|---|"]
    flagship = None
    for name, fn in QUERIES.items():
        if name in STREAMING:
            continue
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        scans = "<br>".join(f"{p}: {f} ({c})" for p, f, c in s["scans"]) or "-"
        joins = ", ".join(f"{k} ×{v}" for k, v in s["joins"].items()) or "-"
        lines.append(f"| `{name}` | {scans} | {joins} | {s['shuffles']} | {s['partial_aggs']} | {s['python']} |")
        if name == "usage_rollup":
            flagship = df
    if flagship is not None:
        formatted = flagship._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        lines += ["", "## `usage_rollup` (simple)", "", "```", formatted.strip(), "```"]
    with open(out, "w") as f:
        f.write("\n".join(lines) + "\n")
    print(out)


if __name__ == "__main__":
    main()
