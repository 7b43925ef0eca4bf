"""Summarise the final adaptive plan of every reference query.

    python explain_plans.py [sf_dir] > PLANS.md

Each query's own DataFrame is executed, so its adaptive plan is the final one. Files
that a query writes before (CSV, pages, tables, checkpoints) are jobs of their own
and not shown.

Per query: shuffles by kind, broadcasts, join strategies, windows, partial
aggregates, Python evaluation (must be none) and the pushed scan filters.
"""

from __future__ import annotations

import re
import sys


def summarise(plan: str) -> dict[str, str]:
    ex = re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)", plan)
    kinds: dict[str, int] = {}
    for k in ex:
        kinds[k] = kinds.get(k, 0) + 1
    joins = sorted(set(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|"
                                  r"CartesianProduct)", plan)))
    pushed = sorted(set(p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if p))
    return {
        "shuffles": ", ".join(f"{v} {k}" for k, v in sorted(kinds.items())) or "none",
        "broadcasts": str(plan.count("BroadcastExchange")),
        "joins": ", ".join(joins) or "none",
        "windows": str(len(re.findall(r"\bWindow \[", plan))),
        "partial aggs": str(len(re.findall(r"partial_", plan))),
        "python": "yes" if re.search(r"EvalPython|PythonUDF|InPandas", plan) else "no",
        "reused": str(plan.count("ReusedExchange")),
        "pushed filters": "; ".join(pushed)[:120] or "-",
    }


def main(argv: list[str]) -> None:
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    sys.path.insert(0, ".")
    from thermoload.plans.queries import QUERIES
    from thermoload.session import build_session

    spark = build_session("local[8]", shuffle_partitions=8)
    cols = ["shuffles", "broadcasts", "joins", "windows", "partial aggs", "python", "reused", "pushed filters"]
    print(f"# Final adaptive plans ({sf}, local[8])\n")
    print("Generated by `explain_plans.py`. Broadcasts are either explicit on relations of fixed size "
          "(the 4-row station mapping, the offsets of range partitions, at most 5 sampled facilities) or chosen by AQE after "
          "measuring a side at runtime. Files that a query writes before its own plan runs are not shown.\n")
    print("| query | " + " | ".join(cols) + " |")
    print("| --- " * (len(cols) + 1) + "|")
    for name, fn in QUERIES.items():
        df = fn(spark, sf)
        done = df._jdf.queryExecution()
        done.toRdd().count()  # executes this very plan; a write would execute another
        text = done.executedPlan().toString()
        assert "isFinalPlan=false" not in text, name
        s = summarise(text.split("== Initial Plan ==")[0])
        print(f"| {name} | " + " | ".join(s[c].replace("|", "/") for c in cols) + " |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
