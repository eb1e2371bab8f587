"""Water-quality-index pivot (J12: B15, E10, C10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import WQI_COLUMNS


def wqi_pivot(
    df: DataFrame,
    columns: Sequence[str] = WQI_COLUMNS,
    date_grain: str | None = None,
    unit_col: str = "mcl_units",
) -> DataFrame:
    """(station, date) × ``label_unit`` → mean value; rows with any empty cell are dropped.

    ``label_unit`` = ``parlabel || '_' || <limit unit>`` (one key per label). Each listed column is one
    conditional mean, so the pivot is a single aggregate with map-side combine. ``date_grain``
    (``'year'``, ``'month'``…) truncates the date first. The values are those of ``parval``: pass
    converted samples (``enrich_samples(..., keep_units=True)``), or means mix units.
    """
    date = F.col("logdate") if date_grain is None else F.trunc(F.col("logdate"), date_grain)
    key = F.concat(F.col("parlabel"), F.lit("_"), F.col(unit_col))
    src = df.select(F.col("wid").alias("station"), date.alias("date"), key.alias("_key"), F.col("parval"))
    src = src.filter(F.col("_key").isin(list(columns)))
    cells = [F.avg(F.when(F.col("_key") == c, F.col("parval"))).alias(c) for c in columns]
    return src.groupBy("station", "date").agg(*cells).dropna(how="any")
