"""Date parsing with a per-row rule (no column-wide loss when one value is odd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date_text(c: str | Column) -> Column:
    """ISO ``yyyy-M-d`` or US ``M/d/yyyy`` text to DATE; a midnight time part is trimmed first.

    Anything else (impossible dates, non-midnight times, junk, empty) gives NULL.
    """
    s = F.trim(F.col(c) if isinstance(c, str) else c)
    s = F.regexp_replace(s, r"[ T]00:00(:00(\.0+)?)?$", "")
    return F.coalesce(F.try_to_date(s, "yyyy-M-d"), F.try_to_date(s, "M/d/yyyy"))


def to_date(c: str | Column) -> Column:
    """DATE from a DATE/TIMESTAMP/TIMESTAMP_NTZ column (typed sources)."""
    return (F.col(c) if isinstance(c, str) else c).cast("date")
