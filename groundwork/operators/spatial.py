"""Proximity and containment joins on a planar grid.

Catalyst alone plans a distance predicate as a broadcast nested-loop join (every block × every well).
Here both sides get grid-cell keys and meet in an ordinary equi-join, planned as a shuffle (sort-merge)
join on the cell: neither side has a provable broadcast bound at scale, a hot cell is split by AQE's
skew-join handling, and the CPU-heavy work after the join (exact distances, edge rows) runs in as many
tasks as there are cell partitions — a broadcast join would instead stream whichever side happened to
be small, possibly as a single task.

* the well (point) side gets exactly one cell, ``floor(x / cell), floor(y / cell)``;
* the block side is exploded into every cell its bounding box, grown by the radius, touches.

A (block, well) pair within the radius therefore meets in exactly one cell — no duplicates, no
DISTINCT — and the exact distance is a filter on the joined rows. The pair count is bounded by the
local density, never by blocks × wells. A very dense cell is a skewed join key: AQE splits it, because
what follows a join groups by (polygon, point), never by the join's own cell keys, so it has an exchange
of its own. ``salt`` can also spread the point side of every cell over more tasks (the block side is
replicated per salt).

Polygons come with the cells they cover (``coverage``): a point in an inside cell needs no edge, and cells that
a polygon's box holds but the polygon does not reach are not joined at all.

Reductions over a candidate's polygon edges are keyed by the point's whole content. Equal points meet an edge as
often as they occur, so that number is found along the way (``_n``) and the result is repeated: points that repeat
an id, or have none, are counted one by one, and a retried task finds the same keys again. ``geoid`` is unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import edge_crossing, edge_distance, rings_bbox, rings_edges
from ..params import PROXIMITY_RADIUS_M
from .coverage import coverage_cells, polygon_coverage


def _cell_range(lo: Column, hi: Column, cell: float) -> Column:
    return F.sequence(F.floor(lo / F.lit(cell)), F.floor(hi / F.lit(cell)))


def _explode_cells(df: DataFrame, minx, miny, maxx, maxy, cell: float, salt: int) -> DataFrame:
    out = df.withColumn("cx", F.explode(_cell_range(minx, maxx, cell))).withColumn(
        "cy", F.explode(_cell_range(miny, maxy, cell))
    )
    if salt > 1:
        out = out.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return out


def _point_cells(points: DataFrame, x: str, y: str, cell: float, salt: int, id_col: str) -> DataFrame:
    out = points.withColumn("cx", F.floor(F.col(x) / F.lit(cell))).withColumn("cy", F.floor(F.col(y) / F.lit(cell)))
    if salt > 1:
        out = out.withColumn("salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salt)).cast("int"))
    return out


def _points_side(wells: DataFrame, well_cols: Sequence[str], id_col: str) -> DataFrame:
    keep = [c for c in well_cols if c not in (id_col, "x_m", "y_m")]
    return wells.filter(F.col("x_m").isNotNull() & F.col("y_m").isNotNull()).select(
        id_col, F.col("x_m").alias("_px"), F.col("y_m").alias("_py"), *keep
    )


_RUN = 4096


def _repeated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every row ``_n`` times; in runs, so that no long array is made."""
    runs = df.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / _RUN))))
    length = F.least(F.lit(_RUN).cast("bigint"), F.col("_n") - F.col("_run") * _RUN)
    return runs.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), length))).select(*columns)


def point_pairs(
    blocks: DataFrame,
    wells: DataFrame,
    radius: float = PROXIMITY_RADIUS_M,
    cell: float | None = None,
    salt: int = 1,
    well_cols: Sequence[str] = ("wid",),
    id_col: str = "wid",
) -> DataFrame:
    """Pairs of block points (``geoid, x_m, y_m``) and wells (``wid, x_m, y_m``) at most ``radius`` apart.

    Columns: ``geoid, <well_cols>, dist``.
    """
    cell = float(cell or radius)
    b = blocks.filter(F.col("x_m").isNotNull() & F.col("y_m").isNotNull()).select(
        "geoid", F.col("x_m").alias("_bx"), F.col("y_m").alias("_by")
    )
    r = F.lit(float(radius))
    b = _explode_cells(b, F.col("_bx") - r, F.col("_by") - r, F.col("_bx") + r, F.col("_by") + r, cell, salt)
    w = _point_cells(_points_side(wells, well_cols, id_col), "_px", "_py", cell, salt, id_col)
    keys = ["cx", "cy"] + (["salt"] if salt > 1 else [])
    j = b.hint("merge").join(w, keys)
    dx = F.col("_px") - F.col("_bx")
    dy = F.col("_py") - F.col("_by")
    j = j.withColumn("dist", F.sqrt(dx * dx + dy * dy)).filter(F.col("dist") <= r)
    return j.select("geoid", *[c for c in well_cols if c not in ("x_m", "y_m")], "dist")


def _salted(cells: DataFrame, salt: int) -> DataFrame:
    return cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))) if salt > 1 else cells


def _edge_rows(j: DataFrame) -> DataFrame:
    """One row per (candidate pair, polygon edge): crossing flag and distance, plain codegen arithmetic."""
    e = j.withColumn("_m", F.size("_edges")).withColumn("_e", F.explode("_edges")).drop("_edges")
    args = (F.col("_e.ax"), F.col("_e.ay"), F.col("_e.bx"), F.col("_e.by"), F.col("_px"), F.col("_py"))
    return e.withColumn("_cross", edge_crossing(*args)).withColumn("_d", edge_distance(*args)).drop("_e")


def _by_pair(edge_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (polygon, point content): copies of the point ``_n``, edges crossed by one of them, least distance."""
    g = edge_rows.groupBy(*keys).agg(
        F.bool_or("_in").alias("_in"), F.sum("_cross").alias("_cross"), F.min("_d").alias("_d"),
        F.count(F.lit(1)).alias("_rows"), F.max("_m").alias("_m"),
    )
    g = g.withColumn("_n", F.call_function("div", "_rows", F.col("_m").cast("bigint")))
    return g.withColumn("_cross", F.call_function("div", "_cross", "_n")).drop("_rows", "_m")


def polygon_pairs(
    blocks: DataFrame,
    wells: DataFrame,
    radius: float = PROXIMITY_RADIUS_M,
    cell: float | None = None,
    salt: int = 1,
    well_cols: Sequence[str] = ("wid",),
    id_col: str = "wid",
    strategy: str = "pair",
    large_edges: int = 64,
) -> DataFrame:
    """Pairs of block polygons (``geoid, rings``) and wells at most ``radius`` from the polygon (0 inside).

    ``strategy``:

    * ``'pair'`` — candidates are (block, well) pairs from the block's grid cells (bounding box grown by
      the radius); each candidate is exploded into one row per polygon edge, and ray crossings plus edge
      distances (plain codegen arithmetic) are reduced per pair. Best for small blocks with few edges.
    * ``'edge'`` — every edge is gridded on its own (its bounding box grown by the radius), so a well
      meets only the edges near it; the inside test joins wells inside the block's box with just the
      edges in the well's horizontal band. Rows grow with edges *near* wells, not edges × wells in the
      box: the strategy for large rural blocks with many vertices.
    * ``'auto'`` — blocks wider or taller than the radius, or with more than ``large_edges`` edges, go
      the edge way, the rest the pair way (one union; the well side is read by both).
    """
    cell = float(cell or radius)
    if strategy == "pair":
        return _polygon_pairs_by_pair(blocks, wells, radius, cell, salt, well_cols, id_col)
    if strategy == "edge":
        return _polygon_pairs_by_edge(blocks, wells, radius, cell, salt, well_cols, id_col)
    if strategy != "auto":
        raise ValueError(f"unknown strategy {strategy!r}")
    minx, miny, maxx, maxy = rings_bbox("rings")
    n_edges = F.size(F.flatten(F.col("rings"))) - F.size(F.col("rings"))
    big = ((maxx - minx) > F.lit(radius)) | ((maxy - miny) > F.lit(radius)) | (n_edges > F.lit(large_edges))
    tagged = blocks.withColumn("_big", big)
    small, large = tagged.filter(~F.col("_big")).drop("_big"), tagged.filter(F.col("_big")).drop("_big")
    return _polygon_pairs_by_pair(small, wells, radius, cell, salt, well_cols, id_col).unionByName(
        _polygon_pairs_by_edge(large, wells, radius, cell, salt, well_cols, id_col)
    )


def _polygon_pairs_by_pair(blocks, wells, radius, cell, salt, well_cols, id_col) -> DataFrame:
    r = F.lit(float(radius))
    b = _salted(coverage_cells(blocks, cell, float(radius)), salt)
    w = _point_cells(_points_side(wells, well_cols, id_col), "_px", "_py", cell, salt, id_col)
    keys = ["cx", "cy"] + (["salt"] if salt > 1 else [])
    j = b.hint("merge").join(w, keys)
    bx = F.greatest(F.col("_minx") - F.col("_px"), F.lit(0.0), F.col("_px") - F.col("_maxx"))
    by = F.greatest(F.col("_miny") - F.col("_py"), F.lit(0.0), F.col("_py") - F.col("_maxy"))
    j = j.filter(bx * bx + by * by <= r * r)
    extra = [c for c in well_cols if c not in (id_col, "x_m", "y_m")]
    g = _by_pair(_edge_rows(j), ["geoid", "_px", "_py", id_col, *extra])
    g = g.withColumn("dist", F.when(F.col("_in") | (F.col("_cross") % 2 == 1), F.lit(0.0)).otherwise(F.col("_d")))
    return _repeated(g.filter(F.col("dist") <= r), ["geoid", *[c for c in well_cols if c not in ("x_m", "y_m")], "dist"])


def _edges_table(blocks: DataFrame) -> DataFrame:
    """One row per polygon edge: ``geoid, _ei`` (its number), ``ax, ay, bx, by``."""
    b = blocks.select("geoid", F.posexplode(rings_edges("rings")).alias("_ei", "_e"))
    return b.select("geoid", "_ei", *[F.col(f"_e.{c}").alias(c) for c in ("ax", "ay", "bx", "by")])


def _polygon_pairs_by_edge(blocks, wells, radius, cell, salt, well_cols, id_col) -> DataFrame:
    r = F.lit(float(radius))
    extra = [c for c in well_cols if c not in (id_col, "x_m", "y_m")]
    edges = _edges_table(blocks)
    w = _point_cells(_points_side(wells, well_cols, id_col), "_px", "_py", cell, salt, id_col)
    keys = ["cx", "cy"] + (["salt"] if salt > 1 else [])
    args = (F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("_px"), F.col("_py"))

    # distance: edges gridded over their own box grown by the radius
    ge = _explode_cells(
        edges,
        F.least("ax", "bx") - r, F.least("ay", "by") - r, F.greatest("ax", "bx") + r, F.greatest("ay", "by") + r,
        cell, salt,
    )
    near = ge.hint("merge").join(w, keys).withColumn("_d", edge_distance(*args)).filter(F.col("_d") <= r)
    point = ["_px", "_py", id_col, *extra]
    none = F.lit(0).alias("_cross")
    near = near.select("geoid", *point, F.lit("near").alias("_kind"), "_ei", F.col("_d").alias("dist"), none)

    # inside: wells of inside cells; those of boundary cells ray-cast against the edges of their horizontal band
    cover = polygon_coverage(blocks, cell).drop("_edges")
    cells = cover.select("geoid", F.explode("_inside").alias("_c"), F.lit(True).alias("_in")).unionByName(
        cover.select("geoid", F.explode("_near").alias("_c"), F.lit(False).alias("_in"))
    )
    cells = _salted(cells.select("geoid", F.col("_c.cx").alias("cx"), F.col("_c.cy").alias("cy"), "_in"), salt)
    met = cells.hint("merge").join(w, keys)
    within = met.filter(F.col("_in")).select(
        "geoid", *point, F.lit("within").alias("_kind"), F.lit(-1).alias("_ei"), F.lit(0.0).alias("dist"), none
    )
    inbox = met.filter(~F.col("_in")).select("geoid", *point, F.floor(F.col("_py") / F.lit(cell)).alias("_band"))
    banded = edges.select(
        "*",
        F.explode(F.sequence(F.floor(F.least("ay", "by") / F.lit(cell)), F.floor(F.greatest("ay", "by") / F.lit(cell)))).alias("_band"),
    )
    crossings = inbox.join(banded, ["geoid", "_band"]).select(
        "geoid", *point, F.lit("band").alias("_kind"), "_ei", F.lit(None).cast("double").alias("dist"), edge_crossing(*args).alias("_cross")
    )

    # an edge meets every copy of a point once in each part, so copies are counted by edge and merged
    rows = near.unionByName(within).unionByName(crossings)
    by_edge = rows.groupBy("geoid", *point, "_kind", "_ei").agg(
        F.count(F.lit(1)).alias("_n"), F.min("dist").alias("dist"), F.max("_cross").alias("_cross")
    )
    out = by_edge.groupBy("geoid", *point).agg(
        F.max("_n").alias("_n"), F.min("dist").alias("dist"), F.sum("_cross").alias("_cross")
    )
    out = out.withColumn("dist", F.when(F.col("_cross") % 2 == 1, F.lit(0.0)).otherwise(F.col("dist")))
    out = out.filter(F.col("dist").isNotNull())
    return _repeated(out, ["geoid", *[c for c in well_cols if c not in ("x_m", "y_m")], "dist"])


def points_in_polygons(
    polygons: DataFrame,
    points: DataFrame,
    id_col: str,
    cell: float = 1000.0,
    point_cols: Sequence[str] = (),
) -> DataFrame:
    """Pairs (polygon, point) where the point lies inside the polygon (D15): equi-join on covered cells; points of
    inside cells are done, those of boundary cells take the even-odd ray cast as exploded edge rows summed per
    (polygon, point). Points that repeat an id, or have none, give one row each.
    Columns: ``geoid, <id_col>, <point_cols>``."""
    cell = float(cell)
    extra = [c for c in point_cols if c not in (id_col, "x_m", "y_m")]
    p = _point_cells(_points_side(points, (id_col, *extra), id_col), "_px", "_py", cell, 1, id_col)
    j = coverage_cells(polygons, cell).hint("merge").join(p, ["cx", "cy"])
    inside_box = (
        (F.col("_px") >= F.col("_minx")) & (F.col("_px") <= F.col("_maxx"))
        & (F.col("_py") >= F.col("_miny")) & (F.col("_py") <= F.col("_maxy"))
    )
    g = _by_pair(_edge_rows(j.filter(inside_box)), ["geoid", "_px", "_py", id_col, *extra])
    return _repeated(g.filter(F.col("_in") | (F.col("_cross") % 2 == 1)), ["geoid", id_col, *extra])


def proximity_pairs(
    blocks: DataFrame,
    wells: DataFrame,
    radius: float = PROXIMITY_RADIUS_M,
    well_cols: Sequence[str] = ("wid",),
    **kw,
) -> DataFrame:
    """(block, well, distance) for every well within ``radius`` of a block (D11): blocks given as points
    (``x_m, y_m``) use ``point_pairs``, blocks given as polygons (``rings``) use ``polygon_pairs``."""
    if "rings" in blocks.columns:
        return polygon_pairs(blocks, wells, radius, well_cols=well_cols, **kw)
    return point_pairs(blocks, wells, radius, well_cols=well_cols, **kw)
