"""Summarise the physical plan of every relational query into PLANS.md.

For each query: shuffles by kind, broadcasts, joins, windows, scans, and any
Python evaluation. Cached fixture subtrees (InMemoryRelation) are counted
once in the "fixtures" row, not in every query that reads them.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PATTERNS = {
    "hash shuffle": r"Exchange hashpartitioning",
    "range shuffle": r"Exchange rangepartitioning",
    "to one partition": r"Exchange SinglePartition",
    "broadcast": r"BroadcastExchange",
    "sort-merge join": r"SortMergeJoin",
    "broadcast join": r"BroadcastHashJoin|BroadcastNestedLoopJoin",
    "window": r"\bWindow\b",
    "file scan": r"FileScan \w+|Scan (parquet|csv|json)",
    "checkpoint scan": r"Scan ExistingRDD",
    "cached scan": r"InMemoryTableScan",
    "python": r"PythonUDF|BatchEvalPython|ArrowEvalPython|MapInPandas|MapInArrow|FlatMapGroupsInPandas",
}


def own_lines(plan: str) -> list[str]:
    """Plan lines without the subtrees of cached relations."""
    out, skip_indent = [], None
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" :+-"))
        if skip_indent is not None:
            if indent > skip_indent:
                continue
            skip_indent = None
        out.append(line)
        if "InMemoryRelation" in line:
            skip_indent = indent
    return out


def summarise(plan: str, own: bool = True) -> dict[str, int]:
    lines = own_lines(plan) if own else plan.splitlines()
    text = "\n".join(lines)
    return {k: len(re.findall(p, text)) for k, p in PATTERNS.items()}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from keepwise.plans import fixtures as fx
    from keepwise.plans.registry import oracles, queries
    from keepwise.session import local_session

    spark = local_session()
    rows = []
    from keepwise.operators.cleaning import clean

    def clean_raw(spark, sf):  # before any query caches it
        return clean(fx.raw_table(spark, sf))

    for name, build in [("fixtures: snap", fx.snap), ("fixtures: sub", fx.sub), ("fixtures: scored", fx.scored_fx),
                        ("fixtures: clean(raw)", clean_raw)]:
        df = build(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows.append((name, summarise(plan, own=(name == "fixtures: snap"))))
    exact = oracles()
    for key, fn in queries().items():
        if key not in exact:
            continue
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        rows.append((key, summarise(plan)))
    cols = list(PATTERNS)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` at `{sf_dir}` (initial adaptive plans; AQE may")
    print("still coalesce partitions or switch a join to broadcast at run time). Counts exclude the")
    print("subtrees of cached fixtures, which are built once per session (first rows).\n")
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for key, s in rows:
        print(f"| {key} | " + " | ".join(str(s[c]) if s[c] else "" for c in cols) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
