"""Globally ordered output with an index, stage counts on the way, the package on the workers."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from groundwork import operators as op
from groundwork import sinks
from groundwork.plans import catalog as cat
from groundwork.plans import jobs
from groundwork.sources import lookups
from groundwork.sources import testdata as td

SF = "/root/testdata/sf0.001"


def test_ordered_sink_numbers_all_files(spark, tmp_path):
    df = spark.range(0, 5000, 1, 8).select((F.col("id") * 7919 % 5003).alias("k"), F.lit("x").alias("v"))
    path = str(tmp_path / "ordered")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_ordered(df, path, ["k"], index="n")
        sinks.write_ordered(df, str(tmp_path / "csv"), ["k"], fmt="csv", descending=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    assert len(files) > 1
    seen = [tuple(r) for f in files for r in spark.read.parquet(f"{path}/{f}").select("n", "k").collect()]
    assert [n for n, _ in seen] == list(range(5000)) and [k for _, k in seen] == sorted(k for _, k in seen)
    names = sorted(f for f in os.listdir(tmp_path / "csv") if f.startswith("part-"))
    ks = [int(line.split(",")[0]) for f in names for line in (tmp_path / "csv" / f).read_text().splitlines()[1:]]
    assert ks == sorted(ks, reverse=True) and len(ks) == 5000


def test_stage_counts_on_the_way(spark, tmp_path):
    counts = op.StageCounts()
    raw, loc = td.samples_raw(spark, SF), cat._locations(spark, SF)
    mcl, units = lookups.mcl_table(spark), lookups.unit_table(spark)
    out = jobs.clean_enrich_job(raw, loc, mcl, units, out=str(tmp_path), since=cat.SINCE, counts=counts)
    got = counts.rows()
    listed = op.restrict_to_listed(raw, mcl)
    assert list(got) == ["raw", "listed", "clean", "enriched", "result"]
    assert got["raw"] == raw.count() and got["listed"] == listed.count()
    assert got["clean"] == op.clean_samples(listed, with_ids=False).count()
    assert got["result"] == out.count() < got["enriched"]


def test_polygons_from_another_folder(tmp_path):
    """Workers find the package wherever the driver was started."""
    code = (
        f"import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})\n"
        "from groundwork.session import local_session\n"
        "from groundwork.sources import shapes\n"
        "spark = local_session(1)\n"
        "df = spark.sql('SELECT array(array(named_struct(\\'x\\', 0D, \\'y\\', 1D))) AS rings')\n"
        "print('RINGS', df.select(shapes.rings_from_wkb(shapes.wkb_from_rings('rings')).alias('r')).first().r[0][0].y)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=150)
    assert "RINGS 1.0" in done.stdout, done.stderr[-2000:]
