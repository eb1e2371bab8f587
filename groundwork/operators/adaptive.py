"""Proximity join on a grid whose cells follow the data.

``spatial.point_pairs`` joins on cells of one size, so a town's cell holds thousands of times the rows of a desert's. Here a
cell with more than ``limit`` rows (of both sides) is cut into four, and each quarter again, down to ``depth`` cuts:

1. rows are counted by the smallest cells (partial per task: a hot place is one row a task);
2. the smallest cells' counts are summed up to their ancestors, in windows of at most ``4^depth`` counted cells each; a smallest
   cell's leaf is its first ancestor within the limit;
3. a leaf of the smallest size that is still over the limit (many wells at one place) is dealt into parts on both sides:
   each well is in one part of the wells, each block in one part of the blocks, and every two parts meet once;
4. wells go to their one leaf, blocks to all leaves that their circle touches, and both meet on (leaf, parts).

A pair meets exactly once, as a well has one leaf and a block has each leaf at most once. Nothing is dropped or capped, and the
cut depends on the rows alone, so a retried task finds the same leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import PROXIMITY_RADIUS_M
from .joins import splittable_join

LIMIT = 20_000
DEPTH = 6


def _place(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("bigint")


def _up(v: Column, levels: Column) -> Column:
    return F.call_function("shiftright", v, levels.cast("int"))


def _leaf_table(wells: DataFrame, blocks: DataFrame, cell: float, limit: int, depth: int) -> DataFrame:
    """``fx, fy`` (an occupied smallest cell), ``cut`` (times its base cell is cut there), ``wparts, bparts``."""
    tiny = cell / (1 << depth)

    def places(df: DataFrame, x: str, y: str, well: int) -> DataFrame:
        return df.select(_place(F.col(x), tiny).alias("fx"), _place(F.col(y), tiny).alias("fy"), F.lit(well).alias("_w"))

    counted = (
        places(wells, "_px", "_py", 1)
        .unionByName(places(blocks, "_bx", "_by", 0))
        .groupBy("fx", "fy")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("nw"))
    )
    levels = counted.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    up = F.lit(depth) - F.col("d")
    node = Window.partitionBy("d", _up(F.col("fx"), up), _up(F.col("fy"), up))
    levels = levels.withColumn("over", (F.sum("n").over(node) > limit) & (F.col("d") < depth))
    leaves = levels.groupBy("fx", "fy").agg(F.count_if("over").cast("int").alias("cut"), F.max("n").alias("n"), F.max("nw").alias("nw"))

    def parts(n: Column) -> Column:
        dealt = F.greatest(F.ceil(n / F.lit(limit)), F.lit(1)).cast("int")
        return F.when((F.col("cut") == depth) & (F.col("n") > limit), dealt).otherwise(1)

    return leaves.select("fx", "fy", "cut", parts(F.col("nw")).alias("wparts"), parts(F.col("n") - F.col("nw")).alias("bparts"))


def adaptive_point_pairs(
    blocks: DataFrame,
    wells: DataFrame,
    radius: float = PROXIMITY_RADIUS_M,
    well_cols: Sequence[str] = ("wid",),
    id_col: str = "wid",
    limit: int = LIMIT,
    depth: int = DEPTH,
    cell: float | None = None,
) -> DataFrame:
    """Pairs of block points (``geoid, x_m, y_m``) and wells (``wid, x_m, y_m``) at most ``radius`` apart; the rows of
    ``spatial.point_pairs``, with no salt to choose. Columns: ``geoid, <well_cols>, dist``.

    Rows without coordinates pair with nothing; rows that repeat pair once each. ``cell`` is the size of an uncut
    cell (the radius, if not given), ``limit`` the rows of a cell that is left uncut, ``depth`` at most 15 cuts. Rows that
    are equal in id and place share a part.
    """
    cell = float(cell or radius)
    if not 0 <= depth <= 15:
        raise ValueError("depth is between 0 and 15")
    tiny = cell / (1 << depth)
    r = float(radius)
    extra = [c for c in well_cols if c not in (id_col, "x_m", "y_m")]
    w = wells.filter(F.col("x_m").isNotNull() & F.col("y_m").isNotNull()).select(
        id_col, F.col("x_m").alias("_px"), F.col("y_m").alias("_py"), *extra
    )
    b = blocks.filter(F.col("x_m").isNotNull() & F.col("y_m").isNotNull()).select(
        "geoid", F.col("x_m").alias("_bx"), F.col("y_m").alias("_by")
    )
    table = _leaf_table(w, b, cell, limit, depth)
    up = F.lit(depth) - F.col("cut")
    leaf = [_up(F.col("fx"), up).alias("lx"), _up(F.col("fy"), up).alias("ly")]

    # wells: their smallest cell names their leaf; only cut or dealt cells need the table
    w = w.withColumn("fx", _place(F.col("_px"), tiny)).withColumn("fy", _place(F.col("_py"), tiny))
    cuts = table.filter((F.col("cut") > 0) | (F.col("wparts") > 1) | (F.col("bparts") > 1))
    w = splittable_join(w, cuts, ["fx", "fy"], "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    own = F.pmod(F.xxhash64(id_col, "_px", "_py"), F.coalesce("wparts", F.lit(1)).cast("bigint")).cast("int")
    w = w.select(
        id_col, "_px", "_py", *extra, "cut", *leaf, own.alias("wpart"),
        F.explode(F.sequence(F.lit(0), F.coalesce("bparts", F.lit(1)) - 1)).alias("bpart"),
    )

    # blocks: the base cells that the circle's box touches, then the leaves in them that the circle touches
    leaves = table.select(
        _up(F.col("fx"), F.lit(depth)).alias("cx"), _up(F.col("fy"), F.lit(depth)).alias("cy"), "cut", *leaf, "wparts", "bparts"
    ).distinct()
    slack = r * (1 + 1e-9) + 1e-6  # sums and a leaf's edges are rounded; the distance below decides
    for axis in ("x", "y"):
        lo, hi = _place(F.col(f"_b{axis}") - slack, cell), _place(F.col(f"_b{axis}") + slack, cell)
        b = b.withColumn(f"c{axis}", F.explode(F.sequence(lo, hi)))
    size = F.lit(cell) / F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("cut"))

    def gap(p: str, place: str) -> Column:
        low = F.col(place) * size
        return F.greatest(low - F.col(p), F.lit(0.0), F.col(p) - (low + size))

    reached = b.hint("merge").join(leaves, ["cx", "cy"]).filter(
        gap("_bx", "lx") * gap("_bx", "lx") + gap("_by", "ly") * gap("_by", "ly") <= F.lit(slack * slack)
    )
    mine = F.pmod(F.xxhash64("geoid", "_bx", "_by"), F.col("bparts").cast("bigint")).cast("int")
    reached = reached.select(
        "geoid", "_bx", "_by", "cut", "lx", "ly", mine.alias("bpart"),
        F.explode(F.sequence(F.lit(0), F.col("wparts") - 1)).alias("wpart"),
    )

    j = reached.hint("merge").join(w, ["cut", "lx", "ly", "wpart", "bpart"])
    dx, dy = F.col("_px") - F.col("_bx"), F.col("_py") - F.col("_by")
    j = j.withColumn("dist", F.sqrt(dx * dx + dy * dy)).filter(F.col("dist") <= F.lit(r))
    return j.select("geoid", *[c for c in well_cols if c not in ("x_m", "y_m")], "dist")
