"""Repeated and missing ids, hot cells and wells in the plan, damaged and foreign files, lookup order, WKB forms."""

import struct
import zipfile
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from groundwork import operators as op
from groundwork import sinks
from groundwork.functions.geometry import square_rings
from groundwork.plans import jobs
from groundwork.sources import ingest, lookups, providers, shapes


def _square(spark, geoid="b", x=0.0, y=0.0, half=100.0):
    return spark.range(1).select(F.lit(geoid).alias("geoid"), square_rings(F.lit(x), F.lit(y), F.lit(half)).alias("rings"))


@pytest.mark.parametrize("strategy", ["pair", "edge", "auto"])
def test_repeated_and_null_ids_are_counted_one_by_one(spark, strategy):
    pts = spark.createDataFrame(
        [("a", 0.0, 0.0), ("a", 10.0, 0.0), ("a", 10.0, 0.0), (None, 5.0, 5.0), (None, 6.0, 5.0), ("z", 500.0, 0.0)],
        "wid string, x_m double, y_m double",
    )
    inside = op.points_in_polygons(_square(spark), pts, "wid").groupBy("wid").count().collect()
    assert {r.wid: r["count"] for r in inside} == {"a": 3, None: 2}
    pairs = op.polygon_pairs(_square(spark), pts, strategy=strategy).collect()
    assert sorted((r.wid or "", r.dist) for r in pairs) == [("", 0.0), ("", 0.0), ("a", 0.0), ("a", 0.0), ("a", 0.0), ("z", 400.0)]


def test_site_counts_with_shared_facility_ids(spark):
    sites = "Facility_I string, x_m double, y_m double"
    usts = spark.createDataFrame([("f", 1.0, 1.0), ("f", 2.0, 2.0), (None, 3.0, 3.0), (None, 4.0, 4.0)], sites)
    clean = usts.withColumnRenamed("Facility_I", "GLOBAL_ID")
    row = op.blockgroup_site_counts(_square(spark), usts, clean).first()
    assert (row.usts, row.cleanups, row.sites) == (4, 4, 8)


@contextmanager
def conf(spark, **kw):
    old = {k: spark.conf.get(k, None) for k in kw}
    for k, v in kw.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
}


def _final_plan(df):
    df.collect()  # runs this very plan, so that the adaptive one below is the final one
    return df._jdf.queryExecution().executedPlan().toString()


def _hot_points(spark):
    # four fifths of the points share one grid cell
    return spark.range(0, 40_000, 1, 8).select(
        F.concat(F.lit("w"), F.col("id")).alias("wid"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 97).cast("double")).otherwise((F.col("id") * 37 % 90_000).cast("double")).alias("x_m"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 89).cast("double")).otherwise((F.col("id") * 53 % 90_000).cast("double")).alias("y_m"),
    )


def _grid(spark):
    return spark.range(0, 900, 1, 4).select(
        F.col("id").cast("string").alias("geoid"),
        square_rings((F.col("id") % 30 * 3000 + 40).cast("double"), (F.floor(F.col("id") / 30) * 3000 + 40).cast("double"), F.lit(90.0)).alias("rings"),
    )


def test_hot_cell_is_split(spark):
    with conf(spark, **SKEW):
        for df in (op.polygon_pairs(_grid(spark), _hot_points(spark)), op.points_in_polygons(_grid(spark), _hot_points(spark), "wid")):
            assert "skew=true" in _final_plan(df)


def test_hot_well_never_meets_an_aggregate_above_its_join(spark):
    """Per-well results count first (partial per task) and join the wells afterwards: no join below the aggregate."""
    n = spark.range(0, 50_000, 1, 8)
    samples = n.select(
        F.when(F.col("id") % 4 > 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 50)).alias("wid"),
        F.date_add(F.lit("2001-01-01"), (F.col("id") % 400).cast("int")).alias("logdate"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("id") % 3 + 1).cast("int")).alias("parlabel"),
        (F.col("id") % 7).cast("double").alias("magnitude"),
    )
    wells = samples.select("wid").distinct().withColumn("field_pt_class", F.lit("MW"))
    with conf(spark, **SKEW):
        stats = op.combo_stats(samples, ["A", "B", "C"], [1, 2, 3], classes=["MW"], wells=wells)
        assert stats.filter(F.col("wells") == wells.count()).count() == 7
        mags = op.wells_with_mag(wells, op.well_magnitude(samples))
        for df in (stats, mags, op.label_lists(samples).join(wells, "wid", "left_semi")):
            lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
            depth = lambda word: [len(x) - len(x.lstrip(" :+-")) for x in lines if x.lstrip(" :+-").startswith(word)]  # noqa: B023, E731
            assert depth("Join") and max(depth("Join")) < max(depth("Aggregate"))
        spec = op.spec_wells(samples, ["A", "B", "C"], wells=wells)
        assert spec.filter("wid = 'hot'").count() == 37_500
        assert "skew=true" in _final_plan(spec.select("wid", "logdate", "parlabel", "magnitude"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_well_is_split_in_the_join_with_deduplicated_locations(spark, how):
    samples = spark.range(0, 50_000, 1, 8).select(
        F.when(F.col("id") % 4 > 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 50)).alias("wid"),
        F.col("id").cast("string").alias("parlabel"),
    )
    raw = spark.range(0, 400, 1, 4).select(
        F.when(F.col("id") % 2 > 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 50)).alias("wid"),
        F.lit("MW").alias("field_pt_class"), F.col("id").cast("double").alias("latitude"), F.lit(1.0).alias("longitude"),
        F.lit(0).alias("source_rank"), F.lit("p").alias("path"), F.col("id").alias("line_no"),
    )
    with conf(spark, **SKEW):
        joined = op.join_locations(samples, op.dedup_locations(raw), how)
        assert "skew=true" in _final_plan(joined)
        assert joined.count() == (50_000 if how == "left" else samples.join(raw, "wid", "left_semi").count())
        assert joined.columns == ["wid", "parlabel", "field_pt_class", "latitude", "longitude"]


def _zip(path, name, text):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, text)


def test_damaged_and_foreign_files(spark, tmp_path):
    lines = "GLOBAL_ID\tFIELD_PT_NAME\tPARLABEL\tPARVAL\n" + "".join(f"T{i}\tMW\tBZ\t{i}\n" for i in range(120_000))
    for county in ("Ventura", "Orange", "Humboldt"):
        _zip(tmp_path / f"{county}EDF.zip", "a.txt", lines)
    damaged = bytearray((tmp_path / "OrangeEDF.zip").read_bytes())
    damaged[len(damaged) * 2 // 3] ^= 0xFF
    (tmp_path / "OrangeEDF.zip").write_bytes(bytes(damaged))
    got = ingest.land_lines(spark, str(tmp_path))
    n = {r.path.rsplit("/", 1)[1]: (r.n, r.bad) for r in got.groupBy("path").agg(F.count("line").alias("n"), F.count("error").alias("bad")).collect()}
    assert n == {"VenturaEDF.zip": (120_001, 0), "OrangeEDF.zip": (0, 1), "HumboldtEDF.zip": (120_001, 0)}
    own = jobs.load_samples(spark, str(tmp_path), None, areas=["Ventura"])
    assert {r[0] for r in own.select("area").distinct().collect()} == {"Ventura"}


def test_unknown_store_is_an_error_row(spark):
    import pandas as pd

    out = pd.concat(ingest._unzip_batches(iter([pd.DataFrame({"path": ["nosuch://x/a.zip"]})])))
    assert out["line"].isna().all() and out["error"].notna().all()


def test_first_lookup_entry_wins(spark):
    raw = spark.createDataFrame([("w", "2001-01-01", "BZ", 4.0, "MG/L")], "wid string, d string, parlabel string, parval double, units string")
    raw = raw.select("wid", F.col("d").cast("date").alias("logdate"), "parlabel", "parval", "units")
    entries = [("BZ", "first", 2.0, "MCL", "MG/L"), ("BZ", "second", 1.0, "MCL", "MG/L")]
    units = lookups.unit_table(spark)
    for rows in (entries, entries[::-1]):
        out = op.enrich_samples(raw, None, lookups.mcl_table(spark, rows), units, dedup_after=True).collect()
        assert [(r.chem_name, r.comp_conc_val) for r in out] == [(rows[0][1], rows[0][2])]


def test_pivot_of_enriched_samples(spark):
    raw = spark.createDataFrame(
        [("w", "2001-01-01", "BZ", 4.0, "MG/L"), ("w", "2001-02-01", "BZ", 2000.0, "UG/L")],
        "wid string, d string, parlabel string, parval double, units string",
    ).select("wid", F.col("d").cast("date").alias("logdate"), "parlabel", "parval", "units")
    mcl = lookups.mcl_table(spark, [("BZ", "Benzene", 1.0, "MCL", "UG/L")])
    e = op.enrich_samples(raw, None, mcl, lookups.unit_table(spark), keep_units=True)
    assert [r["BZ_UG/L"] for r in op.wqi_pivot(e, ["BZ_UG/L"], date_grain="year").collect()] == [3000.0]


def _wkb(kind, dims, srid=None):
    head = struct.pack("<BI", 1, kind) + (b"" if srid is None else struct.pack("<I", srid))
    pts = [(0, 0), (4, 0), (4, 4), (0, 0)]
    body = struct.pack("<II", 1, len(pts)) + b"".join(struct.pack("<" + "d" * dims, *(*p, *[9] * (dims - 2))) for p in pts)
    return head + body


@pytest.mark.parametrize(("kind", "dims", "srid"), [(3, 2, None), (1003, 3, None), (2003, 3, None), (3003, 4, None), (0x80000003, 3, None), (0x20000003, 2, 4326), (0xE0000003, 4, 26911)])
def test_wkb_dimensions(kind, dims, srid):
    assert [[(p["x"], p["y"]) for p in r] for r in shapes.wkb_to_rings_py(_wkb(kind, dims, srid))] == [[(0, 0), (4, 0), (4, 4), (0, 0)]]


def test_wkb_other_types_raise():
    with pytest.raises(ValueError):
        shapes.wkb_to_rings_py(struct.pack("<BIdd", 1, 1, 0.0, 0.0))


def test_geographic_blocks_and_layers(spark, tmp_path):
    wells = spark.createDataFrame([("w", 34.0, -118.0)], "wid string, latitude double, longitude double")
    at = op.project_utm(wells).first()
    blocks = spark.range(1).select(F.lit("b").alias("geoid"), square_rings(F.lit(-118.0), F.lit(34.0), F.lit(0.001)).alias("rings"))
    planar = op.project_utm(blocks)
    xs = [p.x for p in planar.first().rings[0]]
    assert min(xs) < at.x_m < max(xs) and max(xs) - min(xs) == pytest.approx(185, abs=5)
    mags = op.project_utm(wells).withColumn("mag", F.lit(2.0))
    scores = op.block_score(planar, mags, geometry="polygon")
    assert scores.first().score == pytest.approx(2.0)
    sinks.write_wells_layer(mags, str(tmp_path / "wells"))
    sinks.write_block_scores(scores, str(tmp_path / "blocks"), planar)
    back = spark.read.parquet(str(tmp_path / "blocks")).select("geoid", "score", shapes.rings_from_wkb("geometry").alias("rings"))
    assert back.first().rings == planar.first().rings and spark.read.parquet(str(tmp_path / "wells")).columns == ["wid", "mag", "latitude", "longitude", "x_m", "y_m"]


def test_study_area_from_provider_files(spark, tmp_path):
    head = "\t".join(providers.GEO_UST_COLS)
    _zip(tmp_path / "ust.zip", "u.txt", head + "\n" + "".join(f"F{i}\tN\tstreet {i}\tC\tZ\tVentura\t34.0\t-118.0\n" for i in range(3)))
    head = "\t".join(providers.CLEANUP_FILE_COLS)
    _zip(tmp_path / "clean.zip", "c.txt", head + "\nG\tN\t1\tS\tC\tZ\tT\tOPEN\t34.0\t-118.0\n")
    parse = lambda name, cols: ingest.parse_delimited(ingest.land_lines(spark, str(tmp_path), name), cols)
    usts = providers.geotracker_usts(parse("ust.zip", providers.GEO_UST_COLS))
    cleanups = providers.cleanup_sites(parse("clean.zip", providers.CLEANUP_FILE_COLS))
    groups = spark.range(2).select(
        F.col("id").cast("string").alias("geoid"), square_rings(F.lit(-118.0) + F.col("id"), F.lit(34.0), F.lit(0.01)).alias("rings"),
        F.lit(1.0).alias("water_table_depth_m"), F.lit(True).alias("is_dac"),
    )
    got = jobs.study_area_job(op.project_utm(groups), [usts], cleanups, out=str(tmp_path / "out")).collect()
    assert [(r.geoid, r.usts, r.cleanups) for r in got] == [("0", 3, 1)]


def test_combinations_of_many_labels(spark):
    labels = [f"L{i:02d}" for i in range(40)]
    rows = [("w", "2001-01-01", labels[i]) for i in (0, 5, 39) for _ in range(4)]
    df = spark.createDataFrame(rows, "wid string, d string, parlabel string").withColumn("logdate", F.col("d").cast("date"))
    got = op.visit_combo_support(df, labels, 2).filter("n > 0").select("contaminants").collect()
    assert sorted(r[0] for r in got) == ["['L00', 'L05']", "['L00', 'L39']", "['L05', 'L39']"]
    with pytest.raises(ValueError):
        op.visit_combo_support(df, labels, 20)
    many = [f"M{i}" for i in range(70)]
    visits = spark.createDataFrame([("w", "2001-01-01", m) for m in many], "wid string, d string, parlabel string").withColumn("logdate", F.col("d").cast("date"))
    assert op.visits_with_all(visits, many).count() == 70


def test_zscore_of_equal_values(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "mag double")
    assert op.zscore_outliers(df).count() == 2
