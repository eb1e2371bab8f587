"""Cells that polygons cover, and the joins that use them, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from groundwork.operators.coverage import coverage_cells, polygon_coverage
from groundwork.operators.spatial import points_in_polygons, polygon_pairs

RINGS = "geoid string, rings array<array<struct<x:double,y:double>>>"


def _star(rng, cx, cy, r, n):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    pts = [(cx + r * rng.uniform(0.3, 1) * math.cos(t), cy + r * rng.uniform(0.3, 1) * math.sin(t)) for t in turns]
    return [*pts, pts[0]]


def _square(cx, cy, h):
    return [(cx - h, cy - h), (cx + h, cy - h), (cx + h, cy + h), (cx - h, cy + h), (cx - h, cy - h)]


def _polygons():
    rng = random.Random(5)
    out = [(f"s{i}", [_star(rng, rng.uniform(-3000, 3000), rng.uniform(-3000, 3000), rng.choice([50, 900, 2500]), 9)]) for i in range(12)]
    out.append(("grid", [_square(0, 0, 2000)]))  # edges on the lines between cells
    out.append(("hole", [_square(100, 100, 2600), _square(300, 200, 1100)]))
    out.append(("flat", [[(-2000, 5.0), (2000, 5.0), (2000, 5.0001), (-2000, 5.0), (-2000, 5.0)]]))
    out.append(("thin", [[(-3000.0, -3000.0), (3000.0, 2999.0), (3000.0, 3000.0), (-3000.0, -3000.0)]]))
    out.append(("open", [[(-500.0, -500.0), (1500.0, -500.0), (1500.0, 1500.0)]]))
    return out + [("none", [])]


def _points():
    rng = random.Random(6)
    pts = [(str(i), rng.uniform(-4500, 4500), rng.uniform(-4500, 4500)) for i in range(350)]
    pts += [(None, float(x), float(y)) for x in range(-2500, 2501, 500) for y in range(-2500, 2501, 500)]
    return pts + [("0", *pts[0][1:]), ("0", *pts[0][1:]), ("0", 1.0, 2.0)]


def _look(rings, px, py):
    odd, near = False, math.inf
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if (ay > py) != (by > py) and px < ax + (bx - ax) * (py - ay) / (by - ay):
                odd = not odd
            dx, dy = bx - ax, by - ay
            n = dx * dx + dy * dy
            t = min(1, max(0, ((px - ax) * dx + (py - ay) * dy) / n)) if n else 0
            near = min(near, math.hypot(px - ax - t * dx, py - ay - t * dy))
    return odd, near


@pytest.fixture(scope="module")
def tables(spark):
    polygons = [(g, [[(float(x), float(y)) for x, y in r] for r in rings]) for g, rings in _polygons()]
    points = spark.createDataFrame(_points(), "wid string, x_m double, y_m double")
    return spark.createDataFrame(polygons, RINGS), points


def _key(row):
    return tuple("" if v is None else str(v) for v in row)


@pytest.mark.parametrize("strategy", ["pair", "edge", "auto"])
@pytest.mark.parametrize("cell", [None, 210.0])
def test_pairs_equal_brute_force(tables, strategy, cell):
    polygons, points = tables
    got = polygon_pairs(polygons.filter("geoid != 'open'"), points, 600.0, cell=cell, strategy=strategy).collect()
    want = []
    for g, rings in _polygons():
        if g == "open":  # has no inside
            continue
        for wid, x, y in _points():
            odd, near = _look(rings, x, y)
            if odd or near <= 600:
                want.append((g, wid, 0.0 if odd else near))
    got, want = sorted(map(tuple, got), key=_key), sorted(want, key=_key)
    assert sorted((_key(r[:2])) for r in got) == sorted(_key(r[:2]) for r in want)
    assert sum(r[2] for r in got) == pytest.approx(sum(r[2] for r in want))


@pytest.mark.parametrize("cell", [130.0, 1000.0])
def test_containment_equals_brute_force(tables, cell):
    polygons, points = tables
    got = points_in_polygons(polygons.filter("geoid != 'open'"), points, "wid", cell).collect()
    want = [(g, w) for g, rings in _polygons() if g != "open" for w, x, y in _points() if _look(rings, x, y)[0]]
    assert sorted(map(_key, got)) == sorted(map(_key, want))


def test_inside_cells_hold_no_boundary(tables):
    polygons, _ = tables
    cover = {r["geoid"]: r for r in polygon_coverage(polygons, 100.0).collect()}
    assert "none" not in cover and not cover["open"]["_inside"]
    rng = random.Random(7)
    for g, rings in _polygons():
        if g in cover:
            for c in cover[g]["_inside"]:
                for _ in range(4):
                    assert _look(rings, (c["cx"] + rng.random()) * 100, (c["cy"] + rng.random()) * 100)[0]
            assert not set(map(tuple, cover[g]["_inside"])) & set(map(tuple, cover[g]["_near"]))
    assert len(cover["grid"]["_inside"]) == 38 * 38  # all but the rows of cells that the edges touch
    assert len(cover["thin"]["_near"]) < 300  # a strip, not the box of 3,600 cells


def test_inside_cells_carry_no_edges(tables):
    cells = coverage_cells(tables[0], 100.0)
    counts = cells.groupBy("_in").agg(F.max(F.size("_edges")).alias("most"), F.count("*").alias("n"))
    by = {r["_in"]: r for r in counts.collect()}
    assert by[True]["most"] == 1 and by[True]["n"] > by[False]["n"]


def test_point_keys_do_not_depend_on_tasks(tables):
    polygons, points = tables
    plan = polygon_pairs(polygons, points, 600.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan
    got = polygon_pairs(polygons.filter("geoid = 'grid'"), points.unionAll(points).repartition(7), 600.0)
    assert got.count() == 2 * polygon_pairs(polygons.filter("geoid = 'grid'"), points, 600.0).count()


def test_many_equal_points(spark, tables):
    points = spark.range(10_000).selectExpr("'w' AS wid", "10.0D AS x_m", "10.0D AS y_m")
    assert points_in_polygons(tables[0].filter("geoid = 'grid'"), points, "wid").count() == 10_000
