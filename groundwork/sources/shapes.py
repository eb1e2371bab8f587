"""Polygon geometry in and out as WKB.

Census blocks usually arrive as (Geo)Parquet with a WKB geometry column, and Spark 4.1 has no built-in
that yields coordinates from WKB. These two Arrow-batched pandas UDFs are the only per-row Python in
the geometry path: a small decoder/encoder between WKB Polygon / MultiPolygon (either byte order; Z, M and SRID skipped)
and the ``rings: array<array<struct<x, y>>>`` column every spatial operator uses. All rings of all
parts are kept; the even-odd rule of the operators then treats holes and separate parts correctly.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

RINGS_TYPE = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))

_POLYGON, _MULTIPOLYGON = 3, 6


def _header(buf: bytes, off: int) -> tuple[str, int, int, int]:
    """Byte order, plain type, numbers per vertex and the place behind the header.

    Both ways of marking Z and M are read: thousands (ISO) and the high bits (extended, with an optional
    SRID behind the type). Only x and y are used later.
    """
    endian = "<" if buf[off] == 1 else ">"
    (code,) = struct.unpack_from(endian + "I", buf, off + 1)
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    place = off + 5 + (4 if code & 0x20000000 else 0)
    iso, plain = divmod(code & 0x1FFFFFFF, 1000)
    return endian, plain, dims + (0, 1, 1, 2)[iso], place


def _read_polygon(buf: bytes, off: int, endian: str, dims: int) -> tuple[list, int]:
    (n_rings,) = struct.unpack_from(endian + "I", buf, off)
    off += 4
    rings = []
    for _ in range(n_rings):
        (n_pts,) = struct.unpack_from(endian + "I", buf, off)
        off += 4
        coords = struct.unpack_from(endian + "d" * (dims * n_pts), buf, off)
        off += 8 * dims * n_pts
        rings.append([{"x": coords[dims * i], "y": coords[dims * i + 1]} for i in range(n_pts)])
    return rings, off


def wkb_to_rings_py(wkb: bytes | None) -> list | None:
    """Rings of a WKB Polygon or MultiPolygon (with or without Z, M, SRID); None for NULL.

    Other geometry types raise: a layer that silently lost its blocks would score them 0.
    """
    if wkb is None:
        return None
    buf = bytes(wkb)
    endian, kind, dims, off = _header(buf, 0)
    if kind == _POLYGON:
        return _read_polygon(buf, off, endian, dims)[0]
    if kind == _MULTIPOLYGON:
        (n_parts,) = struct.unpack_from(endian + "I", buf, off)
        off, rings = off + 4, []
        for _ in range(n_parts):
            part_endian, _kind, part_dims, start = _header(buf, off)
            rs, off = _read_polygon(buf, start, part_endian, part_dims)
            rings.extend(rs)
        return rings
    raise ValueError(f"WKB type {kind} is neither Polygon nor MultiPolygon")


def rings_to_wkb_py(rings: list | None) -> bytes | None:
    """Little-endian WKB Polygon of the given rings (first ring outer)."""
    if rings is None:
        return None
    out = [struct.pack("<BII", 1, _POLYGON, len(rings))]
    for ring in rings:
        out.append(struct.pack("<I", len(ring)))
        for p in ring:
            out.append(struct.pack("<dd", p["x"], p["y"]))
    return b"".join(out)


@F.pandas_udf(RINGS_TYPE)
def _wkb_to_rings(col: pd.Series) -> pd.Series:
    return col.map(wkb_to_rings_py)


@F.pandas_udf(T.BinaryType())
def _rings_to_wkb(col: pd.Series) -> pd.Series:
    return col.map(lambda r: None if r is None else rings_to_wkb_py([[{"x": p["x"], "y": p["y"]} for p in ring] for ring in r]))


def _shipped() -> None:
    """The workers need this package, wherever the driver was started."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship_package(spark)


def rings_from_wkb(c: str | Column) -> Column:
    """``rings`` column from a WKB binary column (Polygon / MultiPolygon)."""
    _shipped()
    return _wkb_to_rings(F.col(c) if isinstance(c, str) else c)


def wkb_from_rings(c: str | Column) -> Column:
    """WKB Polygon binary column from ``rings`` (for layers other tools read)."""
    _shipped()
    return _rings_to_wkb(F.col(c) if isinstance(c, str) else c)
