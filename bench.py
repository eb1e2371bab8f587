"""Benchmark the headline jobs.

Runs every headline query of ``groundwork.plans.catalog`` over ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints ONE JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {name: sec}, "sf": ...}``.

Each query is forced end to end with the ``noop`` sink (all rows produced, nothing collected to the
driver). An untimed warm-up pass runs the same queries once over the smallest test tables
(``$BENCH_WARMUP_DIR``, default /root/testdata/sf0.001) so JIT and code generation are paid before
timing, as on a long-running cluster JVM; set ``BENCH_WARMUP=0`` to time cold runs.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:]

    from groundwork.plans import catalog
    from groundwork.session import local_session

    n = int(cpus) if cpus.isdigit() else os.cpu_count() or 8
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", max(8, 2 * n)))
    spark = local_session(cpus, shuffle_partitions=parts, app="groundwork-bench")

    def run(name: str, d: str = sf_dir) -> float:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    names = keys or catalog.HEADLINE
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    warm = os.environ.get("BENCH_WARMUP", "1") != "0" and os.path.isdir(warm_dir)
    errors = {}
    if warm:
        for name in names:
            try:
                catalog.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
            except Exception as e:  # noqa: BLE001 - reported below, the bench still prints its line
                errors[name] = f"warm-up: {type(e).__name__}: {str(e)[:200]}"
    times = {}
    for name in names:
        try:
            times[name] = round(run(name), 3)
        except Exception as e:  # noqa: BLE001
            times[name] = None
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {
        "metric": "headline_jobs_total",
        "value": round(sum(t for t in times.values() if t is not None), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "warmup": warm_dir if warm else None,
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
