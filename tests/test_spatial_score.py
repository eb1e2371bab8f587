import pytest
from pyspark.sql import functions as F

from groundwork import operators as op
from groundwork.functions.geometry import square_rings
from groundwork.sources import testdata as td
from groundwork.plans import catalog as cat
from tests.conftest import SF001, rows

BLOCK = "geoid string, x_m double, y_m double"
WELL = "wid string, x_m double, y_m double, mag double"


def test_score_examples(spark):
    blocks = spark.createDataFrame([("b1", 0.0, 0.0), ("b2", 0.0, 0.0), ("b3", 50000.0, 0.0)], BLOCK)
    # Mags 4 at 100 m and 8 at 300 m → adj 4, 4 → gmean 4, mean 4 (block b1)
    wells = spark.createDataFrame([("w1", 100.0, 0.0, 4.0), ("w2", 0.0, 300.0, 8.0)], WELL)
    g = {r.geoid: r.score for r in op.block_score(blocks, wells, "gmean").collect()}
    m = {r.geoid: r.score for r in op.block_score(blocks, wells, "mean").collect()}
    assert g["b1"] == pytest.approx(4.0) and m["b1"] == pytest.approx(4.0)
    assert g["b3"] == 0.0 and m["b3"] == 0.0  # G8
    # Mags 8 at 100 m and 4 at 300 m → adj 8, 2 → gmean 4, mean 5
    wells2 = spark.createDataFrame([("w1", 100.0, 0.0, 8.0), ("w2", 0.0, 300.0, 4.0)], WELL)
    assert op.block_score(blocks, wells2, "gmean").filter("geoid='b1'").first().score == pytest.approx(4.0)
    assert op.block_score(blocks, wells2, "mean").filter("geoid='b1'").first().score == pytest.approx(5.0)


def test_neighbouring_cells_one_pair(spark):
    # Block and well in neighbouring grid cells, 999 m apart → exactly one pair
    blocks = spark.createDataFrame([("b", 999.5, 10.0)], BLOCK)
    wells = spark.createDataFrame([("w", 1998.5, 10.0, 1.0)], WELL)
    assert op.point_pairs(blocks, wells).count() == 1
    assert op.point_pairs(blocks, wells, salt=4).count() == 1


def test_grid_join_equals_brute_force(spark):
    blocks = td.block_points(spark, SF001)
    wells = cat._locations(spark, SF001)
    grid = rows(op.point_pairs(blocks, wells).select("geoid", "wid", F.bround("dist", 6).alias("d")))
    b = blocks.toPandas()
    w = wells.select("wid", "x_m", "y_m").toPandas()
    m = b.merge(w, how="cross", suffixes=("_b", "_w"))
    m["d"] = ((m.x_m_w - m.x_m_b) ** 2 + (m.y_m_w - m.y_m_b) ** 2) ** 0.5
    brute = sorted((r.geoid, r.wid, round(r.d, 6)) for r in m[m.d <= 1000].itertuples())
    assert [(a, b_, pytest.approx(c)) for a, b_, c in grid] == brute
    salted = rows(op.point_pairs(blocks, wells, salt=3).select("geoid", "wid"))
    assert salted == [(a, b_) for a, b_, _ in grid]


def test_polygon_pairs_equal_square_closed_form(spark):
    pts = td.block_points(spark, SF001)
    polys = td.blocks(spark, SF001)
    wells = cat._locations(spark, SF001)
    got = rows(op.polygon_pairs(polys, wells).select("geoid", "wid", F.bround("dist", 6).alias("d")))
    b = pts.toPandas()
    w = wells.select("wid", "x_m", "y_m").toPandas()
    m = b.merge(w, how="cross", suffixes=("_b", "_w"))
    dx = ((m.x_m_w - m.x_m_b).abs() - m.half_m).clip(lower=0)
    dy = ((m.y_m_w - m.y_m_b).abs() - m.half_m).clip(lower=0)
    m["d"] = (dx * dx + dy * dy) ** 0.5
    brute = sorted((r.geoid, r.wid, round(r.d, 6)) for r in m[m.d <= 1000].itertuples())
    assert len(got) == len(brute)
    assert [(a, b_) for a, b_, _ in got] == [(a, b_) for a, b_, _ in brute]


def test_points_in_polygon_half_open_square(spark):
    polys = spark.createDataFrame([("q", 5.0, 5.0, 5.0)], "geoid string, x double, y double, h double")
    polys = polys.select("geoid", square_rings("x", "y", "h").alias("rings"))
    pts = spark.createDataFrame([("in", 5.0, 5.0), ("left", 0.0, 5.0), ("right", 10.0, 5.0), ("out", 11.0, 5.0)],
                                "id string, x_m double, y_m double")
    assert rows(op.points_in_polygons(polys, pts, "id"), "id") == [("in",), ("left",)]


def test_every_block_scored_once_nonnegative(spark):
    s = cat.q_block_score_gmean(spark, SF001)
    assert s.count() == s.select("geoid").distinct().count() == td.block_points(spark, SF001).count()
    assert s.filter("score < 0").count() == 0


def _ring(pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def test_polygon_strategies_agree(spark):
    """'pair', 'edge' and 'auto' give the same pairs and distances, on small squares and on a large
    many-vertex polygon with a hole."""
    import math

    polys = td.blocks(spark, SF001)
    wells = cat._locations(spark, SF001)
    res = {}
    for strat in ("pair", "edge", "auto"):
        res[strat] = rows(op.polygon_pairs(polys, wells, strategy=strat).select("geoid", "wid", F.bround("dist", 6).alias("d")))
    assert res["pair"] == res["edge"] == res["auto"]

    n = 200  # large circle-like polygon, radius 5 km, with a square hole
    outer = [(10000 + 5000 * math.cos(2 * math.pi * k / n), 10000 + 5000 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    outer.append(outer[0])
    hole = [(9000, 9000), (11000, 9000), (11000, 11000), (9000, 11000), (9000, 9000)]
    big = spark.createDataFrame([("big", [_ring(outer), _ring(hole)])], "geoid string, rings array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame(
        [("center", 10000.0, 10000.0), ("ring", 13000.0, 10000.0), ("edge_out", 15500.0, 10000.0), ("far", 16500.0, 10000.0),
         ("in_hole_near", 10900.0, 10000.0)], "wid string, x_m double, y_m double")
    got = {s: {r.wid: round(r.dist, 3) for r in op.polygon_pairs(big, pts, strategy=s).collect()} for s in ("pair", "edge", "auto")}
    assert got["pair"] == got["edge"] == got["auto"]
    g = got["edge"]
    assert g["ring"] == 0.0  # between hole and outer boundary: inside
    assert g["in_hole_near"] == pytest.approx(100.0, abs=1e-3)  # in the hole, 100 m from its edge
    assert g["center"] == pytest.approx(1000.0, abs=1e-3)  # inside the hole, 1 km from its edge
    assert 499.0 < g["edge_out"] < 501.0 and "far" not in g
