"""Depth-to-water (DTW): provider union, attach to samples, coverage and extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DTW_UNITS, MONITORING_CLASSES
from .clean import DEFAULT_ORDER, DTW_REQUIRED, keep_first, require, union_all
from .joins import splittable_join


def dtw_union(*providers: DataFrame, order: Sequence[str] = DEFAULT_ORDER, units: str = DTW_UNITS) -> DataFrame:
    """Union provider readings (``wid, logdate, dtw`` + ingest order), label units, drop incomplete rows,
    keep the first reading per (well, date)."""
    df = union_all(*providers).withColumn("dtw_units", F.lit(units))
    df = require(df, DTW_REQUIRED)
    df = keep_first(df, ["wid", "logdate"], order)
    return df.select("wid", "logdate", "dtw", "dtw_units")


def attach_dtw(samples: DataFrame, dtw: DataFrame, how: str = "left") -> DataFrame:
    """Join readings to samples on the visit (well, date) — left (J6) or inner."""
    d = dtw.select("wid", "logdate", "dtw", "dtw_units")
    return splittable_join(samples, d, ["wid", "logdate"], how)


def all_dtw(samples_dtw: DataFrame, labels: Sequence[str], classes: Sequence[str] = MONITORING_CLASSES,
            cols: Sequence[str] | None = None) -> DataFrame:
    """Monitoring-well samples of the listed labels that have a DTW reading."""
    df = samples_dtw.filter(F.col("dtw").isNotNull())
    df = df.filter(F.col("field_pt_class").isin(list(classes))).filter(F.col("parlabel").isin(list(labels)))
    return df.select(*cols) if cols else df


def dtw_coverage(samples_dtw: DataFrame) -> DataFrame:
    """Samples and wells with a DTW reading against all screened samples, with percentages.

    Input is the screened samples *left*-joined to the readings (readings are unique per visit, so the
    join does not fan out). One aggregate, one row: ``samples, samples_dtw, samples_pct, wells,
    wells_dtw, wells_pct`` (percent rounded half-even to 2 places).
    """
    has = F.col("dtw").isNotNull()
    # two plain aggregates (per well, then totals) instead of two DISTINCT aggregates: no row expansion,
    # and a hot well costs one partial row per task
    per_well = samples_dtw.groupBy("wid").agg(F.count(F.lit(1)).alias("n"), F.count_if(has).alias("n_dtw"))
    a = per_well.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("samples"),
        F.coalesce(F.sum("n_dtw"), F.lit(0)).cast("bigint").alias("samples_dtw"),
        F.count(F.lit(1)).alias("wells"),
        F.count_if(F.col("n_dtw") > 0).alias("wells_dtw"),
    )
    return a.select(
        "samples",
        "samples_dtw",
        F.bround(F.try_divide(F.col("samples_dtw") * 100.0, F.col("samples")), 2).alias("samples_pct"),
        "wells",
        "wells_dtw",
        F.bround(F.try_divide(F.col("wells_dtw") * 100.0, F.col("wells")), 2).alias("wells_pct"),
    )
