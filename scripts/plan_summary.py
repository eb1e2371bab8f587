"""Summarise the final (post-AQE) physical plan of each headline query as markdown.

Usage: PLAN_CPUS=8 python scripts/plan_summary.py [sf_dir] > docs/PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = ("Exchange", "Join", "WindowGroupLimit", "HashAggregate", "Generate", "FileScan", "AQEShuffleRead")


def summarise(plan: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        node = line.strip().lstrip(":+- ").strip()
        name = node.split(" ", 1)[0].split("(", 1)[0]
        if not any(k in name for k in KEEP):
            continue
        if node.startswith("FileScan"):
            table = re.search(r"/([a-z]+)\.parquet", node)
            pushed = re.search(r"PushedFilters: \[([^\]]*)\]", node)
            schema = re.search(r"ReadSchema: (struct<[^>]*>?)", node)
            node = (f"FileScan {table.group(1) if table else '?'}; pushed [{pushed.group(1) if pushed else ''}]; "
                    f"read {schema.group(1)[:160] if schema else '?'}")
        elif node.startswith("HashAggregate"):
            keys = re.search(r"keys=\[([^\]]*)\]", node)
            node = f"HashAggregate keys [{re.sub(r'#[0-9L]+', '', keys.group(1)) if keys else ''}]" + (
                " (partial)" if "partial_" in node else "")
        else:
            node = re.sub(r"#[0-9L]+", "", node)[:160]
        depth = (len(line) - len(line.lstrip(" :+-|"))) // 3
        out.append("  " * min(depth, 12) + "- " + node)
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from groundwork.plans import catalog
    from groundwork.session import local_session

    spark = local_session(os.environ.get("PLAN_CPUS", "8"), 16)
    print(f"# Final physical plans (post-AQE) at `{sf_dir}`\n")
    print("Generated by `scripts/plan_summary.py`: exchanges, joins, keep-first limits, aggregates and scans")
    print("(with pushed filters and the pruned read schema) of each headline query, after execution. The")
    print("second part has broadcast joins off, as where no table is small enough for one.\n")
    for title, threshold in (("Default settings", None), ("Broadcast joins off", "-1")):
        print(f"# {title}\n")
        if threshold:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", threshold)
        for k in catalog.HEADLINE:
            plan = catalog.QUERIES[k](spark, sf_dir)._jdf.queryExecution()
            plan.toRdd().count()  # runs this very plan: the printed one is final
            final = plan.executedPlan().toString().split("+- == Initial Plan ==")[0]
            print(f"## {k}\n")
            print("\n".join(summarise(final)))
            print()


if __name__ == "__main__":
    main()
