"""Column expressions (built-in Spark functions only; everything stays JVM-side)."""

from .dates import parse_date_text, to_date
from .geometry import (
    distance_to_rings,
    point_in_rings,
    rings_bbox,
    square_rings,
    tm_xy,
    utm_central_meridian,
    utm_xy,
)
from .ids import gid, make_wid, sid, sid_text, strip_spaces
from .weights import band_weight, gmean

__all__ = [
    "band_weight", "distance_to_rings", "gid", "gmean", "make_wid", "parse_date_text", "point_in_rings",
    "rings_bbox", "sid", "sid_text", "square_rings", "strip_spaces", "tm_xy", "to_date",
    "utm_central_meridian", "utm_xy",
]
