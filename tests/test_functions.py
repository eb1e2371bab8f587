import datetime as dt

import pytest

from groundwork.functions import (
    band_weight,
    distance_to_rings,
    gmean,
    make_wid,
    parse_date_text,
    point_in_rings,
    sid_text,
    tm_xy,
    utm_xy,
)
from groundwork.functions.geometry import CLARKE1866


def test_wid_concat_and_strip(spark):
    df = spark.createDataFrame([("T06 01", "MW 1"), (None, "MW1"), ("T1", None)], "g string, p string")
    got = [r[0] for r in df.select(make_wid("g", "p")).collect()]
    assert got == ["T0601-MW1", None, None]  # D1, D2


def test_dates_per_row_rule(spark):
    vals = ["2015-03-02", "3/2/2015", "2015-03-02 00:00:00", "2015-13-02", "2015-03-02 10:00:00", "", None, "2015-3-2"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(parse_date_text("s")).collect()]
    d = dt.date(2015, 3, 2)
    assert got == [d, d, d, None, None, None, None, d]  # D3, D4


def test_sid_text(spark):
    df = spark.createDataFrame([("W1", dt.date(2015, 3, 2), "BZ"), ("W1", None, None)], "wid string, logdate date, parlabel string")
    assert [r[0] for r in df.select(sid_text()).collect()] == ["W1 2015-03-02 BZ", "W1 NaT nan"]


def test_utm_snyder_example(spark):
    # Snyder's worked example: Clarke 1866, 40.5N 73.5W, central meridian -75, no false easting (G1).
    df = spark.createDataFrame([(-73.5, 40.5)], "lon double, lat double")
    x, y = tm_xy("lon", "lat", -75.0, CLARKE1866, 0.9996, 0.0, 0.0)
    r = df.select(x.alias("x"), y.alias("y")).first()
    assert r.x == pytest.approx(127106.5, abs=0.1)
    assert r.y == pytest.approx(4484124.4, abs=0.1)


def test_utm_central_meridian_symmetry(spark):
    df = spark.createDataFrame([(-117.0, 0.0), (-117.0, 34.0), (-116.0, 34.0), (-118.0, 34.0)], "lon double, lat double")
    x, y = utm_xy("lon", "lat", 11)
    r = df.select(x.alias("x"), y.alias("y")).collect()
    assert r[0].x == pytest.approx(500000.0, abs=1e-6) and r[0].y == pytest.approx(0.0, abs=1e-6)  # G2
    assert r[1].x == pytest.approx(500000.0, abs=1e-6)
    assert r[2].x - 500000 == pytest.approx(500000 - r[3].x, abs=1e-6)
    assert r[2].y == pytest.approx(r[3].y, abs=1e-6)


def _square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def test_polygon_distance_and_hole(spark):
    outer = _square(0, 0, 10, 10)
    hole = _square(3, 3, 7, 7)
    schema = "rings array<array<struct<x:double,y:double>>>, px double, py double"
    data = [
        ([outer], 5.0, 5.0), ([outer], 15.0, 5.0), ([outer], 13.0, 14.0),  # G3: 0, 5, 5
        ([outer, hole], 5.0, 5.0),  # G4: inside the hole → 2 to the hole edge
        ([outer, hole], 2.0, 5.0),  # in the ring between hole and outer → 0
    ]
    df = spark.createDataFrame([([[{"x": float(a), "y": float(b)} for a, b in r] for r in rings], px, py) for rings, px, py in data], schema)
    got = [r[0] for r in df.select(distance_to_rings("rings", "px", "py")).collect()]
    assert got == pytest.approx([0.0, 5.0, 5.0, 2.0, 0.0])
    inside = [r[0] for r in df.select(point_in_rings("rings", "px", "py")).collect()]
    assert inside == [True, False, False, False, True]


def test_band_weights(spark):
    ds = [0.0, 249.9, 250.0, 500.0, 750.0, 1000.0, 1000.1]
    df = spark.createDataFrame([(d,) for d in ds], "d double")
    got = [r[0] for r in df.select(band_weight("d")).collect()]
    assert got == [1.0, 1.0, 0.5, 0.25, 0.1, 0.1, None]  # G5


def test_gmean_guards(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 8.0), (2, 0.0), (2, 5.0), (3, -1.0), (3, 4.0)], "g int, x double")
    got = {r.g: r.m for r in df.groupBy("g").agg(gmean("x").alias("m")).collect()}
    assert got[1] == pytest.approx(4.0) and got[2] == 0.0 and got[3] is None  # G9
