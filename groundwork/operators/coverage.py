"""Grid cells that a polygon covers: wholly inside, or near its boundary.

Both lists are made from the polygon's own edges in one projection, without a shuffle. A point in an inside
cell lies in the polygon, so no edge is looked at; a point in a cell of neither list is outside and farther
away than asked for, so it never meets the polygon. Only boundary cells carry the edges.

* Boundary cells: every edge is clipped to each row of cells (grown by the distance asked for), and the cells
  under the clipped piece are listed, so a long diagonal edge lists a strip and not its bounding box.
* Inside cells: the line through the middle of a row of cells is cut by the edges; between the first and second
  cut, the third and fourth, and so on, the middles of cells lie inside. Those that no edge touches lie inside
  as a whole.

Pieces are grown by a small part of a cell against rounding, which only moves cells to the boundary list. A
polygon with a ring that is not closed has no even cuts, and one no larger than a cell holds none: all cells of
their grown boxes are boundary cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import rings_bbox, rings_edges

_TOLERANCE = 1e-4  # of a cell
_CELLS = "array<struct<cx:bigint,cy:bigint>>"
_EDGE = "struct<ax:double,ay:double,bx:double,by:double>"


def _cell(cx: Column, cy: Column) -> Column:
    return F.struct(cx.cast("bigint").alias("cx"), cy.cast("bigint").alias("cy"))


def _run(first: Column, last: Column) -> Column:
    """``first..last``, empty where ``first > last``."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _index(value: Column, cell: float) -> Column:
    return F.floor(value / F.lit(cell)).cast("bigint")


def _edge_cells(e: Column, cell: float, grow: float) -> Column:
    """Cells at most ``grow`` from the edge, and some more."""
    g = F.lit(grow + cell * _TOLERANCE)
    ylo, yhi = F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])
    xlo, xhi = F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])

    def x_at(y):
        t = F.try_divide(y - e["ay"], e["by"] - e["ay"])
        return F.greatest(xlo, F.least(xhi, e["ax"] + (e["bx"] - e["ax"]) * t))

    def row(cy):
        low = x_at(F.greatest(ylo, cy * F.lit(cell) - g))
        high = x_at(F.least(yhi, (cy + 1) * F.lit(cell) + g))
        first = F.coalesce(F.least(low, high), xlo) - g
        last = F.coalesce(F.greatest(low, high), xhi) + g
        level = e["ay"] == e["by"]
        first, last = F.when(level, xlo - g).otherwise(first), F.when(level, xhi + g).otherwise(last)
        return F.transform(_run(_index(first, cell), _index(last, cell)), lambda cx: _cell(cx, cy))

    return F.flatten(F.transform(_run(_index(ylo - g, cell), _index(yhi + g, cell)), row))


def _row_cuts(e: Column, cell: float) -> Column:
    """Where the edge cuts the middle lines of rows of cells: ``struct<cy, x>``."""
    middle = lambda cy: (cy + F.lit(0.5)) * F.lit(cell)
    rows = _run(_index(F.least(e["ay"], e["by"]), cell), _index(F.greatest(e["ay"], e["by"]), cell))
    rows = F.filter(rows, lambda cy: (e["ay"] > middle(cy)) != (e["by"] > middle(cy)))

    def cut(cy):
        x = e["ax"] + F.try_divide((e["bx"] - e["ax"]) * (middle(cy) - e["ay"]), e["by"] - e["ay"])
        return F.struct(cy.alias("cy"), x.alias("x"))

    return F.transform(rows, cut)


def polygon_coverage(polygons: DataFrame, cell: float, grow: float = 0.0) -> DataFrame:
    """One row per polygon (``geoid, rings``) with ``_edges``, its box ``_minx, _miny, _maxx, _maxy`` and two lists
    of cells: ``_inside``, and ``_near`` (not inside, at most ``grow`` from the boundary; some lie farther).

    A polygon without a vertex has empty lists. Work and lists grow with the boundary's length and the area in
    cells, both held in one row, as the polygon itself is.
    """
    cell = float(cell)
    minx, miny, maxx, maxy = rings_bbox("rings")
    g = F.lit(grow + cell * _TOLERANCE)
    p = polygons.select(
        "geoid", minx.alias("_minx"), miny.alias("_miny"), maxx.alias("_maxx"), maxy.alias("_maxy"),
        rings_edges("rings").alias("_edges"),
    ).filter(F.col("_minx").isNotNull())
    small = (F.col("_maxx") - F.col("_minx") <= F.lit(cell)) & (F.col("_maxy") - F.col("_miny") <= F.lit(cell))
    cuts = F.array_sort(F.flatten(F.transform("_edges", lambda e: _row_cuts(e, cell))))
    p = p.withColumn("_cuts", F.when(~small, cuts).otherwise(F.array().cast("array<struct<cy:bigint,x:double>>")))
    pairs = F.transform("_cuts", lambda a, i: F.when(i % 2 == 0, F.struct(a.alias("a"), F.get("_cuts", i + 1).alias("b"))))
    p = p.withColumn("_spans", F.filter(pairs, lambda s: s.isNotNull()))
    p = p.withColumn("_open", F.exists("_spans", lambda s: ~s["a"]["cy"].eqNullSafe(s["b"]["cy"])))

    def span_cells(s):
        first = F.ceil(s["a"]["x"] / F.lit(cell) - F.lit(0.5)).cast("bigint")
        last = F.floor(s["b"]["x"] / F.lit(cell) - F.lit(0.5)).cast("bigint")
        return F.transform(_run(first, last), lambda cx: _cell(cx, s["a"]["cy"]))

    touched = F.flatten(F.transform("_edges", lambda e: _edge_cells(e, cell, 0.0)))
    spanned = F.array_except(F.flatten(F.transform("_spans", span_cells)), touched)
    p = p.withColumn("_boxed", small | F.col("_open"))
    p = p.withColumn("_inside", F.when(F.col("_boxed"), F.array().cast(_CELLS)).otherwise(spanned))
    near = F.flatten(F.transform("_edges", lambda e: _edge_cells(e, cell, float(grow))))
    box = F.flatten(
        F.transform(
            _run(_index(F.col("_miny") - g, cell), _index(F.col("_maxy") + g, cell)),
            lambda cy: F.transform(
                _run(_index(F.col("_minx") - g, cell), _index(F.col("_maxx") + g, cell)), lambda cx: _cell(cx, cy)
            ),
        )
    )
    near = F.when(F.col("_boxed"), box).otherwise(F.array_except(near, F.col("_inside")))
    return p.withColumn("_near", near).drop("_cuts", "_spans", "_open", "_boxed")


def coverage_cells(polygons: DataFrame, cell: float, grow: float = 0.0) -> DataFrame:
    """``polygon_coverage`` as one row per cell: ``geoid, _minx.., cx, cy, _in, _edges``; inside cells carry no edges
    (an array of one NULL, so that exploding keeps the row)."""
    p = polygon_coverage(polygons, cell, grow)
    tag = lambda name, inside: F.transform(name, lambda c: F.struct(c.alias("c"), F.lit(inside).alias("i")))
    p = p.withColumn("_c", F.explode(F.concat(tag("_inside", True), tag("_near", False))))
    edges = F.when(F.col("_c.i"), F.array(F.lit(None).cast(_EDGE))).otherwise(F.col("_edges"))
    return p.select(
        "geoid", "_minx", "_miny", "_maxx", "_maxy",
        F.col("_c.c.cx").alias("cx"), F.col("_c.c.cy").alias("cy"), F.col("_c.i").alias("_in"), edges.alias("_edges"),
    )
