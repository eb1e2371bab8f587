"""Distance-band weights and guarded means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DISTANCE_BANDS


def band_weight(dist: str | Column, bands=DISTANCE_BANDS) -> Column:
    """Weight of a well at ``dist`` metres: ``[lo, hi)`` per band, the last band closed; NULL beyond."""
    d = F.col(dist) if isinstance(dist, str) else dist
    expr = None
    last = len(bands) - 1
    for i, (lo, hi, w) in enumerate(bands):
        cond = (d >= F.lit(lo)) & ((d <= F.lit(hi)) if i == last else (d < F.lit(hi)))
        if i == 0:
            cond = d < F.lit(hi)
        expr = F.when(cond, F.lit(w)) if expr is None else expr.when(cond, F.lit(w))
    return expr


def gmean(x: str | Column) -> Column:
    """Geometric mean aggregate: 0 when a value is 0, NULL when a value is negative, else exp(avg(ln x))."""
    c = F.col(x) if isinstance(x, str) else x
    return (
        F.when(F.count_if(c < 0) > 0, F.lit(None).cast("double"))
        .when(F.count_if(c == 0) > 0, F.lit(0.0))
        .otherwise(F.exp(F.avg(F.ln(c))))
    )
