import struct

import pytest

from groundwork import operators as op
from groundwork.sources.shapes import rings_from_wkb, rings_to_wkb_py, wkb_from_rings, wkb_to_rings_py


def _poly_be(rings):
    out = [struct.pack(">BII", 0, 3, len(rings))]
    for ring in rings:
        out.append(struct.pack(">I", len(ring)))
        for x, y in ring:
            out.append(struct.pack(">dd", x, y))
    return b"".join(out)


SQ = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
HOLE = [(3, 3), (7, 3), (7, 7), (3, 7), (3, 3)]
FAR = [(100, 100), (110, 100), (110, 110), (100, 110), (100, 100)]


def test_wkb_round_trip_and_multipolygon():
    rings = [[{"x": float(x), "y": float(y)} for x, y in r] for r in (SQ, HOLE)]
    assert wkb_to_rings_py(rings_to_wkb_py(rings)) == rings
    assert wkb_to_rings_py(_poly_be([SQ])) == [[{"x": float(x), "y": float(y)} for x, y in SQ]]
    multi = struct.pack("<BII", 1, 6, 2) + rings_to_wkb_py(rings[:1]) + _poly_be([FAR])
    got = wkb_to_rings_py(multi)
    assert len(got) == 2 and got[1][0] == {"x": 100.0, "y": 100.0}


def test_wkb_columns_feed_spatial_operators(spark):
    blocks = spark.createDataFrame([("b", rings_to_wkb_py([[{"x": float(x), "y": float(y)} for x, y in r] for r in (SQ, HOLE)]))],
                                   "geoid string, geom binary")
    blocks = blocks.select("geoid", rings_from_wkb("geom").alias("rings"))
    wells = spark.createDataFrame([("in", 1.0, 1.0), ("hole", 5.0, 5.0), ("out", 13.0, 5.0)], "wid string, x_m double, y_m double")
    got = {r.wid: r.dist for r in op.polygon_pairs(blocks, wells, radius=50.0).collect()}
    assert got == {"in": 0.0, "hole": pytest.approx(2.0), "out": pytest.approx(3.0)}
    back = blocks.select(wkb_from_rings("rings").alias("g")).first().g
    expected = [[p.asDict() for p in ring] for ring in blocks.first().rings]
    assert wkb_to_rings_py(back) == expected and len(expected) == 2
