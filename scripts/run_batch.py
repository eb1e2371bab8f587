"""Run the county batch end to end: landed provider zips → enriched samples → screens → combinations.

    python scripts/run_batch.py --landing DIR --mcl mcl.csv --units units.csv --out DIR
        [--since 2012-01-01] [--elevation DIR] [--frequent WELLS] [--pivot [COLUMN ...]] [--pivot-grain year]
        [--blocks PARQUET [--degrees]] [--blockgroups PARQUET --tanks PARQUET [PARQUET ...] --cleanups PARQUET]

Expected layout under --landing: edf/ gama/ edf_xy/ gama_xy/ (zips, any depth). Every output is a
Parquet table under --out (samples partitioned by area). Steps after the combinations run where their inputs are named:

* ``--frequent``: combinations of all labels that so many wells of an area hold;
* ``--pivot``: water-quality pivot (the default columns, or those named, like ``BZ_UG/L``);
* ``--blocks`` (``geoid`` and ``rings`` or ``x_m, y_m``; ``--degrees``: rings in longitude and latitude): block scores;
* ``--blockgroups``, ``--tanks`` (one table per provider, the first preferred), ``--cleanups``: study area.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def folder_exists(spark, path: str) -> bool:
    """Whether a folder exists in whatever store its path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def main(argv: list[str] | None = None) -> dict:
    ap = argparse.ArgumentParser()
    ap.add_argument("--landing", required=True)
    ap.add_argument("--mcl", required=True)
    ap.add_argument("--units", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--since", default="2012-01-01")
    ap.add_argument("--elevation", default=None)
    ap.add_argument("--frequent", type=int, default=None)
    ap.add_argument("--pivot", nargs="*", default=None)
    ap.add_argument("--pivot-grain", default=None)
    ap.add_argument("--blocks", default=None)
    ap.add_argument("--degrees", action="store_true")
    ap.add_argument("--blockgroups", default=None)
    ap.add_argument("--tanks", nargs="+", default=None)
    ap.add_argument("--cleanups", default=None)
    a = ap.parse_args(argv)
    study = (a.blockgroups, a.tanks, a.cleanups)
    if any(study) and not all(study):
        ap.error("--blockgroups, --tanks and --cleanups belong together")

    from pyspark.sql import SparkSession

    from groundwork.operators import StageCounts
    from groundwork.params import WQI_COLUMNS
    from groundwork.plans import jobs
    from groundwork.session import apply_defaults, ensure_checkpoint_dir
    from groundwork.sources import lookups

    spark = SparkSession.builder.getOrCreate()
    apply_defaults(spark)
    ensure_checkpoint_dir(spark)
    sub = {k: f"{a.landing.rstrip('/')}/{k}" for k in ("edf", "gama", "edf_xy", "gama_xy")}
    have = {k: (v if folder_exists(spark, v) else None) for k, v in sub.items()}
    samples = jobs.load_samples(spark, have["edf"], have["gama"])
    wells = jobs.load_locations(spark, have["edf_xy"], have["gama_xy"])
    mcl, units = lookups.read_mcl(spark, a.mcl), lookups.read_unit_conversion(spark, a.units)
    counts = StageCounts()
    enriched = jobs.clean_enrich_job(samples, wells, mcl, units, out=a.out, counts=counts)
    summary = {"stages": counts.rows(), "samples_enriched": counts.rows()["result"]}  # counted while writing
    if a.elevation:
        joined, _ = jobs.dtw_job(enriched, jobs.load_dtw(spark, a.elevation), out=a.out)
        summary["samples_dtw"] = joined.count()
    summary["spec_samples"] = jobs.spec_job(enriched, since=a.since, out=a.out).count()
    summary["combo_stats"] = jobs.combo_job(enriched, since=a.since, out=a.out)["stats"].count()
    if a.frequent is not None:
        summary["frequent_combos"] = jobs.frequent_combo_job(enriched, a.frequent, since=a.since, out=a.out).count()
    if a.pivot is not None:
        columns = a.pivot or WQI_COLUMNS
        summary["wqi_pivot"] = jobs.pivot_job(samples, wells, mcl, units, columns, a.pivot_grain, out=a.out).count()
    if a.blocks:
        blocks = spark.read.parquet(a.blocks)
        geometry = "polygon" if "rings" in blocks.columns else "point"
        _, scores = jobs.score_job(samples, wells, blocks, mcl, since=a.since, geometry=geometry, out=a.out,
                                   geographic_blocks=a.degrees)
        summary["block_scores"] = scores.count()
    if a.blockgroups:
        tanks = [spark.read.parquet(t) for t in a.tanks]
        area = jobs.study_area_job(spark.read.parquet(a.blockgroups), tanks, spark.read.parquet(a.cleanups), out=a.out)
        summary["study_area"] = area.count()
    print(json.dumps(summary))
    return summary


if __name__ == "__main__":
    main()
