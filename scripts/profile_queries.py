"""Per-query execution profile from Spark's event log (jobs, stages, tasks, input and shuffle bytes).

Usage: python scripts/profile_queries.py [sf_dir] [key ...]   (default: headline keys at sf0.1)

The event log goes to a fresh scratch folder (mktemp); the Spark UI stays off. Prints one JSON object
per query and a markdown table.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.1"
    from groundwork.plans import catalog

    keys = args[1:] or catalog.HEADLINE
    log_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", f"file://{log_dir}")
        .config("spark.eventLog.compress", "false")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = "/root/testdata/sf0.001"
    wall = {}
    for k in keys:
        catalog.QUERIES[k](spark, warm).write.format("noop").mode("overwrite").save()
    for k in keys:
        spark.sparkContext.setJobDescription(f"q:{k}")
        t0 = time.perf_counter()
        catalog.QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        wall[k] = time.perf_counter() - t0
    spark.sparkContext.setJobDescription(None)
    spark.stop()

    (log_path,) = glob.glob(os.path.join(log_dir, "*"))
    files = sorted(glob.glob(os.path.join(log_path, "events_*"))) if os.path.isdir(log_path) else [log_path]
    files.sort(key=lambda f: int(os.path.basename(f).split("_")[1]) if os.path.isdir(log_path) else 0)
    job_q, stage_job, stats = {}, {}, {}
    for line in (ln for f in files for ln in open(f)):
        if True:
            ev = json.loads(line)  # noqa: E501
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                desc = (ev.get("Properties") or {}).get("spark.job.description") or ""
                if desc.startswith("q:"):
                    job_q[ev["Job ID"]] = desc[2:]
                    for sid in ev.get("Stage IDs", []):
                        stage_job[sid] = ev["Job ID"]
            elif kind == "SparkListenerTaskEnd":
                q = job_q.get(stage_job.get(ev.get("Stage ID")))
                if q is None:
                    continue
                m = ev.get("Task Metrics") or {}
                s = stats.setdefault(q, {"jobs": set(), "stages": set(), "tasks": 0, "input_rows": 0, "task_sec": 0.0,
                                         "shuffle_write_mb": 0.0, "shuffle_read_mb": 0.0, "spill_mb": 0.0})
                s["jobs"].add(stage_job[ev["Stage ID"]])
                s["stages"].add(ev["Stage ID"])
                s["tasks"] += 1
                s["input_rows"] += (m.get("Input Metrics") or {}).get("Records Read", 0)
                s["task_sec"] += m.get("Executor Run Time", 0) / 1000
                s["shuffle_write_mb"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0) / 1e6
                r = m.get("Shuffle Read Metrics") or {}
                s["shuffle_read_mb"] += (r.get("Remote Bytes Read", 0) + r.get("Local Bytes Read", 0)) / 1e6
                s["spill_mb"] += m.get("Disk Bytes Spilled", 0) / 1e6
                info = ev.get("Task Info") or {}
                st = s.setdefault("per_stage", {}).setdefault(ev["Stage ID"], [0, 0.0, 0.0])
                st[0] += 1
                dur = (info.get("Finish Time", 0) - info.get("Launch Time", 0)) / 1000
                st[1] = max(st[1], dur)
                st[2] += dur
    print("| query | wall sec | task sec | stages | tasks | input rows | shuffle write MB | shuffle read MB | spill MB |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for k in keys:
        s = stats.get(k, {"jobs": set(), "stages": set(), "tasks": 0, "input_rows": 0, "task_sec": 0.0,
                          "shuffle_write_mb": 0, "shuffle_read_mb": 0, "spill_mb": 0})
        print(f"| {k} | {wall[k]:.2f} | {s['task_sec']:.1f} | {len(s['stages'])} | {s['tasks']} | {s['input_rows']:,} | "
              f"{s['shuffle_write_mb']:.1f} | {s['shuffle_read_mb']:.1f} | {s['spill_mb']:.1f} |")
    if os.environ.get("PROFILE_STAGES"):
        for k in keys:
            per = stats.get(k, {}).get("per_stage", {})
            top = sorted(per.items(), key=lambda kv: -kv[1][2])[:6]
            print(f"{k}: " + "; ".join(f"stage {sid}: {n} tasks, sum {tot:.2f}s, max {mx:.2f}s" for sid, (n, mx, tot) in top))
    print(f"event log: {log_path}", file=sys.stderr)


if __name__ == "__main__":
    main()
