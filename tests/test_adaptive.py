"""Proximity pairs on cells that follow the data, against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from groundwork import operators as op
from groundwork.operators.adaptive import _leaf_table

BLOCK, WELL = "geoid string, x_m double, y_m double", "wid string, x_m double, y_m double, kind string"


def _brute(blocks, wells, radius):
    out = Counter()
    for g, bx, by in blocks:
        for w, px, py, kind in wells:
            if None not in (bx, by, px, py) and math.sqrt((px - bx) ** 2 + (py - by) ** 2) <= radius:
                out[(g, w, kind)] += 1
    return out


def _pairs(spark, blocks, wells, radius, **kw):
    b, w = spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(wells, WELL)
    got = op.adaptive_point_pairs(b, w, radius, ["wid", "kind"], **kw)
    assert got.columns == ["geoid", "wid", "kind", "dist"]
    return Counter((r["geoid"], r["wid"], r["kind"]) for r in got.collect())


def _crowd(rng):
    """A crowded spot, a place that many wells share, far single wells, the borders of cells, null and repeated rows."""
    wells = [(f"c{i}", rng.gauss(0, 40), rng.gauss(0, 40), "a") for i in range(150)]
    wells += [(f"s{i}", 512.0, -512.0, "b") for i in range(60)]
    wells += [(f"f{i}", rng.uniform(-3000, 3000), rng.uniform(-3000, 3000), "c") for i in range(60)]
    wells += [("e1", 100.0, 0.0, "d"), ("e2", -100.0, 0.0, "d"), ("e3", 0.0, 200.0, "d")]
    wells += [("n", None, 1.0, "e"), ("n", 1.0, None, "e"), (None, 5.0, 5.0, "e"), ("r", 7.0, 7.0, "e"), ("r", 7.0, 7.0, "e")]
    blocks = [(f"b{i}", rng.gauss(0, 60), rng.gauss(0, 60)) for i in range(60)]
    blocks += [(f"t{i}", 500.0, -500.0) for i in range(30)] + [("z", 0.0, 0.0), ("z", 0.0, 0.0), ("q", None, 0.0)]
    return blocks + [(f"g{i}", rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for i in range(40)], wells


@pytest.mark.parametrize("limit,depth,cell", [(10, 5, None), (3, 0, None), (7, 3, 777.7), (10_000, 6, None)])
def test_pairs_equal_brute_force(spark, limit, depth, cell):
    blocks, wells = _crowd(random.Random(3))
    want = _brute(blocks, wells, 100.0)
    assert _pairs(spark, blocks, wells, 100.0, limit=limit, depth=depth, cell=cell) == want
    assert max(want.values()) == 4  # two equal blocks and two equal wells pair four times


def test_hot_cells_are_cut_and_shared_places_dealt(spark):
    blocks, wells = _crowd(random.Random(4))
    w = spark.createDataFrame(wells, WELL).dropna(subset=["x_m", "y_m"]).withColumnsRenamed({"x_m": "_px", "y_m": "_py"})
    b = spark.createDataFrame(blocks, BLOCK).dropna().withColumnsRenamed({"x_m": "_bx", "y_m": "_by"})
    limit, depth = 10, 5
    rows = _leaf_table(w, b, 100.0, limit, depth).collect()
    leaf = {(r["fx"], r["fy"]): r for r in rows}
    tiny = 100.0 / (1 << depth)
    sizes = Counter()
    for pts in ((r[1:3] for r in wells), (r[1:3] for r in blocks)):
        for x, y in pts:
            if x is not None and y is not None:
                f = (math.floor(x / tiny), math.floor(y / tiny))
                up = depth - leaf[f]["cut"]
                sizes[(leaf[f]["cut"], f[0] >> up, f[1] >> up)] += 1
    over = {k: n for k, n in sizes.items() if n > limit}
    shared = leaf[(math.floor(512 / tiny), math.floor(-512 / tiny))]
    assert all(k[0] == depth for k in over) and shared["wparts"] == 6
    assert {r["cut"] for r in rows} >= {0, 2, 3}


def test_empty_sides(spark):
    b, w = [("b", 1.0, 1.0)], [("w", 2.0, 2.0, "k")]
    assert _pairs(spark, [], w, 10.0) == {} and _pairs(spark, b, [], 10.0) == {}
    assert _pairs(spark, b, w, 10.0) == {("b", "w", "k"): 1}
    with pytest.raises(ValueError):
        _pairs(spark, b, w, 10.0, depth=16)


def test_hot_place_splits_without_salt(spark):
    """One place with most rows: the final join's largest partition is far below the place's rows."""
    w = spark.range(4000).select(F.concat(F.lit("w"), "id").alias("wid"), F.lit(3.0).alias("x_m"), F.lit(3.0).alias("y_m"))
    b = spark.range(4).select(F.concat(F.lit("b"), "id").alias("geoid"), F.lit(4.0).alias("x_m"), F.lit(3.0).alias("y_m"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        sizes = op.adaptive_point_pairs(b, w, 10.0, limit=100).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in sizes) == 16_000 and max(r["count"] for r in sizes) < 6000
