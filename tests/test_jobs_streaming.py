import os
import zipfile

import pytest
from pyspark.sql import functions as F

from groundwork.plans import jobs
from groundwork.sources import ingest, lookups, providers
from groundwork.streaming import land_stream, read_bronze


def _zip(path, member, lines):
    with zipfile.ZipFile(path, "w") as zf:
        zf.writestr(member, "\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def land(tmp_path_factory):
    root = tmp_path_factory.mktemp("land")
    edf, gama, exy, gxy, elev = (root / n for n in ("edf", "gama", "edf_xy", "gama_xy", "elevation"))
    for d in (edf, gama, exy, gxy, elev):
        d.mkdir()
    h = "\t".join(providers.EDF_SAMPLE_COLS)
    rows = [h]
    for i, lab in enumerate(["BZ", "BZME", "EBZ", "MTBE"]):
        for k in range(4):
            rows.append(f"T1\tMW 1\t{lab}\t{2.0 + k}\t=\t0.5\tUG/L\t2015-0{k + 1}-02")
    rows.append("T2\tMW1\tBZ\t0.5\t<\t0.5\tUG/L\t2015-01-02")
    _zip(edf / "VenturaEDF.zip", "v.txt", rows)
    gh = "\t".join(providers.GAMA_SAMPLE_COLS)
    _zip(gama / "gama_ddw_kern_v2.zip", "g.txt", [gh, "G 1\tBZ\t=\t3.0\tUG/L\t0.5\t2016-05-01"])
    _zip(exy / "VenturaGeoXY.zip", "x.txt", ["\t".join(providers.EDF_LOCATION_COLS), "T1\tMW1\tMW\t34.2\t-119.2", "T2\tMW1\tMW\t34.3\t-119.2"])
    _zip(gxy / "gama_location_construction_v2.zip", "gx.txt", ["\t".join(providers.GAMA_LOCATION_COLS), "G1\tMONITORING\t35.3\t-119.0"])
    _zip(elev / "GeoDTW.zip", "d.txt", ["\t".join(providers.EDF_DTW_COLS), "T1\tMW1\t12.5\t2015-01-02"])
    _zip(elev / "gama_dtw.zip", "e.txt", ["\t".join(providers.GAMA_DTW_COLS), "G 1\t7.0\t2016-05-01"])
    return root


def test_end_to_end_jobs(spark, land, tmp_path):
    out = str(tmp_path / "out")
    s = jobs.load_samples(spark, str(land / "edf"), str(land / "gama"))
    loc = jobs.load_locations(spark, str(land / "edf_xy"), str(land / "gama_xy"))
    mcl = lookups.mcl_table(spark, [("BZ", "Benzene", 1.0, "MCL", "UG/L"), ("BZME", "Toluene", 150.0, "MCL", "UG/L"),
                                    ("EBZ", "Ethylbenzene", 300.0, "MCL", "UG/L"), ("MTBE", "MTBE", 13.0, "MCL", "UG/L")])
    enriched = jobs.clean_enrich_job(s, loc, mcl, lookups.unit_table(spark), out=out)
    assert os.path.isdir(os.path.join(out, "samples_enriched", "area=Ventura"))
    assert enriched.count() == 18  # 16 + T2 + G1
    joined, extract = jobs.dtw_job(enriched, jobs.load_dtw(spark, str(land / "elevation")), out=out)
    assert joined.filter("dtw is not null").count() == 5  # T1-MW1 2015-01-02 (4 labels) + G1
    spec = jobs.spec_job(enriched, ["BZ", "BZME", "EBZ", "MTBE"], since="2015-01-01", out=out)
    assert {r.wid for r in spec.collect()} == {"T1-MW1"}
    combos = jobs.combo_job(enriched, ["BZ", "BZME", "EBZ", "MTBE"], sizes=[2, 3, 4], since="2015-01-01", out=out)
    top = combos["stats"].filter("area = 'Ventura' and c_num = 4").first()
    assert (top.wells, top.samples) == (1, 16)
    blocks = spark.createDataFrame([("b1",)], "geoid string").select(
        "geoid", F.lit(0.0).alias("x_m"), F.lit(0.0).alias("y_m"))
    wells, scores = jobs.score_job(s, loc, blocks, mcl, since="2015-01-01", geometry="point", out=out)
    assert wells.filter("wid = 'T1-MW1'").count() == 1 and scores.count() == 1


def test_landing_stream_processes_each_file_once(spark, land, tmp_path):
    bronze, ck = str(tmp_path / "bronze"), str(tmp_path / "ck")
    q = land_stream(spark, str(land / "edf"), bronze, ck)
    q.awaitTermination(120)
    n1 = read_bronze(spark, bronze).count()
    assert n1 == 18  # header + 17 lines
    q = land_stream(spark, str(land / "edf"), bronze, ck)  # nothing new
    q.awaitTermination(120)
    assert read_bronze(spark, bronze).count() == n1
    _zip(land / "edf" / "KernEDF.zip", "k.txt", ["\t".join(providers.EDF_SAMPLE_COLS), "T9\tMW1\tBZ\t1\t=\t0\tUG/L\t2016-01-01"])
    q = land_stream(spark, str(land / "edf"), bronze, ck)
    q.awaitTermination(120)
    b = read_bronze(spark, bronze)
    assert b.count() == n1 + 2
    parsed = ingest.parse_delimited(b.select(*ingest.LINES_SCHEMA.fieldNames()), providers.EDF_SAMPLE_COLS)
    assert providers.edf_samples(parsed).filter("area = 'Kern'").count() == 1


def test_landing_batch_rerun_is_idempotent(spark, land, tmp_path):
    """Re-running a micro-batch (same epoch id) replaces its partition instead of appending again."""
    from groundwork.streaming import landing

    bronze, ck = str(tmp_path / "bronze2"), str(tmp_path / "ck2")
    landing.land_stream(spark, str(land / "gama"), bronze, ck).awaitTermination(120)
    n = read_bronze(spark, bronze).count()
    assert n == 2
    # simulate a replay of epoch 0 by writing the same batch again through the same writer
    files = spark.read.format("binaryFile").load(str(land / "gama")).select("path")
    lines = files.mapInPandas(ingest._unzip_batches, ingest.LINES_SCHEMA)
    lines = lines.withColumn("landed_on", F.current_date()).withColumn("batch_id", F.lit(0).cast("long"))
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(bronze)
    assert read_bronze(spark, bronze).count() == n


def test_scale_settings_bounds():
    from groundwork.session import MAX_SHUFFLE_PARTITIONS, scale_settings

    big = scale_settings(100e12, 4000)
    assert int(big["spark.sql.shuffle.partitions"]) == min(MAX_SHUFFLE_PARTITIONS, int(100e12 // (1 << 30)) + 1)
    small = scale_settings(1e9, 64)
    assert int(small["spark.sql.shuffle.partitions"]) == 3 * 64  # at least three waves of cores
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_study_area_and_polygon_score_jobs(spark, tmp_path):
    from groundwork import operators as op
    from groundwork.plans import catalog as cat
    from groundwork.sources import testdata as td

    d, out = "/root/testdata/sf0.001", str(tmp_path / "sa")
    u = td.usts(spark, d)
    sa = jobs.study_area_job(td.blockgroups(spark, d), [u.filter("source_rank = 0"), u.filter("source_rank = 1")],
                             td.cleanups(spark, d), out=out)
    assert sa.count() > 0 and sa.filter("pct_rank > 0.25 or not is_dac or water_table_depth_m > 5").count() == 0
    loc = cat._locations(spark, d)
    mcl = cat._score_limits(spark)
    # blocks in projected metres: reuse the adapter squares, wells projected from their lon/lat by the job
    wells, scores = jobs.score_job(td.samples_raw(spark, d), loc, td.blocks(spark, d), mcl, since=cat.SINCE,
                                   geometry="polygon", out=str(tmp_path / "score"))
    assert scores.count() == td.blocks(spark, d).count()
    assert wells.filter("x_m is null or y_m is null").count() == 0 and scores.filter("score < 0").count() == 0


def test_run_batch_script(spark, land, tmp_path):
    import importlib.util

    spec = importlib.util.spec_from_file_location("run_batch", os.path.join(os.path.dirname(__file__), "..", "scripts", "run_batch.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    (tmp_path / "mcl.csv").write_text("chem_abrv,chem_name,comp_conc_val,comp_conc_type,units\nBZ,Benzene,1.0,MCL,UG/L\nBZME,Toluene,150,MCL,UG/L\n")
    (tmp_path / "units.csv").write_text("start_unit,coef\nUG/L,1\nMG/L,1000\n")
    s = mod.main(["--landing", str(land), "--mcl", str(tmp_path / "mcl.csv"), "--units", str(tmp_path / "units.csv"),
                  "--out", str(tmp_path / "out"), "--since", "2015-01-01", "--elevation", str(land / "elevation")])
    assert s["samples_enriched"] == 10  # BZ and BZME rows of T1-MW1 (8), T2 (1), G1 (1)
    assert s["combo_stats"] >= 1


def test_run_batch_later_steps(spark, land, tmp_path):
    import importlib.util

    from groundwork.sources import testdata as td

    d, p = "/root/testdata/sf0.001", {}
    u = td.usts(spark, d)
    blocks = spark.createDataFrame([("near", 297000.0, 3786000.0), ("far", 0.0, 0.0)], "geoid string, x_m double, y_m double")
    tables = {"blocks": blocks, "bg": td.blockgroups(spark, d), "t0": u.filter("source_rank = 0"), "t1": u.filter("source_rank = 1"),
              "cl": td.cleanups(spark, d)}
    for name, df in tables.items():
        p[name] = str(tmp_path / name)
        df.write.parquet(p[name])
    spec = importlib.util.spec_from_file_location("run_batch", os.path.join(os.path.dirname(__file__), "..", "scripts", "run_batch.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    (tmp_path / "mcl.csv").write_text("chem_abrv,chem_name,comp_conc_val,comp_conc_type,units\nBZ,Benzene,1.0,MCL,UG/L\nBZME,Toluene,150,MCL,UG/L\n")
    (tmp_path / "units.csv").write_text("start_unit,coef\nUG/L,1\nMG/L,1000\n")
    base = ["--landing", str(land), "--mcl", str(tmp_path / "mcl.csv"), "--units", str(tmp_path / "units.csv"), "--out", str(tmp_path / "out")]
    s = mod.main([*base, "--since", "2015-01-01", "--frequent", "1", "--pivot", "BZ_UG/L", "BZME_UG/L", "--blocks", p["blocks"],
                  "--blockgroups", p["bg"], "--tanks", p["t0"], p["t1"], "--cleanups", p["cl"]])
    assert s["frequent_combos"] == 3  # BZ, BZME and both, four times each at T1-MW1
    assert s["wqi_pivot"] == 4 and s["block_scores"] == 2 and s["study_area"] > 0
    for name in ("frequent_combos", "wqi_pivot", "block_scores", "study_area"):
        assert spark.read.parquet(str(tmp_path / "out" / name)).count() == s[name]
    with pytest.raises(SystemExit):
        mod.main([*base, "--tanks", p["t0"]])
