"""Write PLANS.md: for every registered query, what its physical plan does --
shuffles, broadcasts, Python (Arrow) stages, scans and the columns they read.

    python tools/plan_report.py [/root/testdata/sf0.01]

Queries with side effects (streams) are skipped; plans are taken before
execution (AQE may still coalesce partitions or turn joins into broadcasts at
run time from real sizes).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SKIP = {"stream_upsert", "stream_embed"}
PY_NODES = ("MapInPandas", "FlatMapGroupsInPandas", "ArrowEvalPython", "BatchEvalPython")


def summarize(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\]", plan)
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)",
                                   plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "python": sum(plan.count(n) for n in PY_NODES),
        "nested_loop": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "scans": len(scans),
        "columns": sorted({c.split("#")[0].strip() for s in scans for c in s.split(",") if c.strip()}),
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from corpusmap.plans.registry import ORACLE_SQL, QUERIES
    from corpusmap.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    rows = []
    for name, fn in QUERIES.items():
        if name in SKIP:
            continue
        s = summarize(fn(spark, sf))
        rows.append((name, s))
    out = ["# Physical plans", "",
           "Generated by `tools/plan_report.py` from the plans of the registered queries at "
           f"`{os.path.basename(sf)}` (before execution; AQE may still coalesce shuffle partitions "
           "or switch a join to broadcast from runtime sizes). Some queries cut their lineage "
           "(`cut_lineage`), so part of their work ran in earlier jobs and shows here as a scan "
           "of the written table.", "",
           "| query | V | shuffles | broadcasts | Python stages | nested-loop joins | scans | columns read |",
           "| --- | --- | --- | --- | --- | --- | --- | --- |"]
    for name, s in rows:
        cols = ", ".join(s["columns"])
        out.append(f"| `{name}` | {'V' if name in ORACLE_SQL else ''} | {s['shuffles']} | {s['broadcasts']} | "
                   f"{s['python']} | {s['nested_loop']} | {s['scans']} | {cols} |")
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out) + "\n")
    print(path)


if __name__ == "__main__":
    main()
