"""Identifier expressions: well id (WID), visit id (GID) and sample id (SID)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_spaces(c: str | Column) -> Column:
    """Remove every space character (literal replace, not a regex)."""
    return F.replace(_c(c), F.lit(" "), F.lit(""))


def make_wid(global_id: str | Column, point_name: str | Column, strip: bool = True) -> Column:
    """``GLOBAL_ID + '-' + FIELD_PT_NAME``; NULL when either part is NULL (``concat``, not ``concat_ws``)."""
    wid = F.concat(_c(global_id), F.lit("-"), _c(point_name))
    return strip_spaces(wid) if strip else wid


def gid(wid: str | Column = "wid", logdate: str | Column = "logdate") -> Column:
    """Visit id: (well, date)."""
    return F.struct(_c(wid).alias("wid"), _c(logdate).alias("logdate"))


def sid(wid: str | Column = "wid", logdate: str | Column = "logdate", parlabel: str | Column = "parlabel") -> Column:
    """Sample id: ((well, date), label)."""
    return F.struct(gid(wid, logdate).alias("gid"), _c(parlabel).alias("parlabel"))


def sid_text(wid: str | Column = "wid", logdate: str | Column = "logdate", parlabel: str | Column = "parlabel") -> Column:
    """Text form ``"WID LOGDATE PARLABEL"`` of the older scripts; missing parts print as ``nan`` / ``NaT``."""
    return F.concat_ws(
        " ",
        F.coalesce(_c(wid), F.lit("nan")),
        F.coalesce(F.date_format(_c(logdate), "yyyy-MM-dd"), F.lit("NaT")),
        F.coalesce(_c(parlabel), F.lit("nan")),
    )
