"""Scale probe: replicate the sf0.1 tables k times (Spark-derived, keys offset per replica) and time the
sample-pipeline jobs on the result, to check that time grows about linearly with rows.

Usage:
  python scripts/scale_probe.py make <out_dir> [k]     # write the k-times tables once (Parquet, many files)
  python scripts/scale_probe.py run <dir> [key ...]    # time queries on <dir> (one JSON line)

The spatial jobs are left out: the adapter places wells and blocks in a fixed 20 km square, so k times
more of each means k^2 more pairs by construction, not by design.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SRC = "/root/testdata/sf0.1"
SAMPLE_KEYS = [
    "clean_samples", "enrich_samples", "all_samples", "spec_wells_11", "samples_dtw", "combo_stats",
    "visit_combo_support", "wqi_pivot", "well_mag_gmean", "stage_counts",
]


def make(out: str, k: int) -> None:
    from pyspark.sql import functions as F

    from groundwork.session import local_session

    spark = local_session(8, 64)
    rep = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_rep")

    def load(name):
        return spark.read.parquet(f"{SRC}/{name}.parquet")

    def span(df, col):
        return int(df.agg(F.max(col)).first()[0]) + 1

    orders, customer, part, supplier, lineitem = (load(n) for n in ("orders", "customer", "part", "supplier", "lineitem"))
    mo, mc, mp, ms = span(orders, "o_orderkey"), span(customer, "c_custkey"), span(part, "p_partkey"), span(supplier, "s_suppkey")
    # offsets keep every key family disjoint across replicas and are multiples of 66, so the adapter's
    # mappings (label = key mod 11, well = custkey div 2, provider = key mod 2) keep their distributions
    def off(m):
        return ((m + 65) // 66) * 66

    mo, mc, mp, ms = off(mo), off(mc), off(mp), off(ms)
    tables = {
        "orders": orders.select("*", rep).withColumn("o_orderkey", F.col("o_orderkey") + F.col("_rep") * mo)
        .withColumn("o_custkey", F.col("o_custkey") + F.col("_rep") * mc),
        "lineitem": lineitem.select("*", rep).withColumn("l_orderkey", F.col("l_orderkey") + F.col("_rep") * mo)
        .withColumn("l_partkey", F.col("l_partkey") + F.col("_rep") * mp)
        .withColumn("l_suppkey", F.col("l_suppkey") + F.col("_rep") * ms),
        "customer": customer.select("*", rep).withColumn("c_custkey", F.col("c_custkey") + F.col("_rep") * mc),
        "part": part.select("*", rep).withColumn("p_partkey", F.col("p_partkey") + F.col("_rep") * mp),
        "supplier": supplier.select("*", rep).withColumn("s_suppkey", F.col("s_suppkey") + F.col("_rep") * ms),
    }
    for name, df in tables.items():
        df.drop("_rep").repartition(32).write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    print(json.dumps({"made": out, "k": k}))


def run(d: str, keys: list[str]) -> None:
    from groundwork.plans import catalog
    from groundwork.session import local_session

    spark = local_session(8, 64)
    for k in keys:  # warm-up on the smallest tables
        catalog.QUERIES[k](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for k in keys:
        t0 = time.perf_counter()
        catalog.QUERIES[k](spark, d).write.format("noop").mode("overwrite").save()
        times[k] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"dir": d, "total": round(sum(times.values()), 3), "queries": times}))


if __name__ == "__main__":
    cmd = sys.argv[1]
    if cmd == "make":
        make(sys.argv[2], int(sys.argv[3]) if len(sys.argv) > 3 else 10)
    else:
        run(sys.argv[2], sys.argv[3:] or SAMPLE_KEYS)
