"""Filters and well / visit screens.

Screens never collect label lists: per-well label counts come from a ``groupBy`` with map-side partial
aggregation (a hot well costs one partial row per task), and the passing wells return to the rows
through a ``left_semi`` join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import MIN_COUNT, MONITORING_CLASSES


def since_filter(df: DataFrame, since: str | None, col: str = "logdate") -> DataFrame:
    """``col >= since`` (ISO date text); ``None`` keeps everything."""
    if since is None:
        return df
    return df.filter(F.col(col) >= F.lit(since).cast("date"))


def contaminant_filter(df: DataFrame, labels: Sequence[str], col: str = "parlabel") -> DataFrame:
    """Keep the listed labels."""
    return df.filter(F.col(col).isin(list(labels)))


def monitoring_wells(df: DataFrame, classes: Sequence[str] = MONITORING_CLASSES, col: str = "field_pt_class") -> DataFrame:
    """Keep monitoring-well classes (C4)."""
    return df.filter(F.col(col).isin(list(classes)))


def detects(raw: DataFrame, since: str | None = None) -> DataFrame:
    """Detections only (C5): qualifier not ``<`` (a missing qualifier passes), value not 0, value above the
    reporting limit (a missing limit fails), optionally ``logdate >= since``."""
    cond = (~F.col("parvq").eqNullSafe("<")) & (F.col("parval") != 0) & (F.col("parval") > F.col("repdl"))
    return since_filter(raw.filter(cond), since)


def _prefilter(df, labels, since, classes, require_dtw):
    f = since_filter(df, since)
    if classes:
        f = monitoring_wells(f, classes)
    if require_dtw:
        f = f.filter(F.col("dtw").isNotNull())
    return contaminant_filter(f, labels)


SALT = 8  # pieces of a well's rows in the join back; the other side has one row per well and piece


def _of_wells(f: DataFrame, passing: DataFrame, wells: DataFrame | None, classes) -> DataFrame:
    """Rows of the passing wells. With ``wells`` (one row per well with its class and location, which become
    columns of the result) the class filter and the location join are made on the passing wells first, so
    the rows themselves meet one join only.

    That join is salted: the per-well side comes out of an aggregate on the well, and a join that used
    its partitioning could not be split by Spark. On (well, piece) both sides have an exchange of their
    own, and a hot well's rows go to ``SALT`` tasks, which Spark may split further.
    """
    passing = passing.select("wid")
    if wells is not None:
        passing = passing.join(monitoring_wells(wells, classes) if classes else wells, "wid")
    passing = passing.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = f.withColumn("_salt", F.pmod(F.xxhash64("logdate", "parlabel"), F.lit(SALT)).cast("int"))
    return salted.join(passing, ["wid", "_salt"], "left_semi" if wells is None else "inner").drop("_salt")


def _label_stats(f: DataFrame) -> DataFrame:
    per_label = f.groupBy("wid", "parlabel").agg(F.count(F.lit(1)).alias("n"))
    return per_label.groupBy("wid").agg(F.count(F.lit(1)).alias("n_labels"), F.min("n").alias("min_n"))


def spec_wells(
    df: DataFrame,
    labels: Sequence[str],
    since: str | None = None,
    min_count: int = MIN_COUNT,
    require_dtw: bool = False,
    classes: Sequence[str] | None = None,
    wells: DataFrame | None = None,
) -> DataFrame:
    """Strict screen (J4): after the date/class/DTW/label filters, a well passes iff it has every one of
    the ``len(labels)`` labels and each at least ``min_count`` times. Returns the filtered rows of
    passing wells. Counts need only two of the columns, so that branch's scan is narrow."""
    f = _prefilter(df, labels, since, classes if wells is None else None, require_dtw)
    passing = _label_stats(f).filter((F.col("n_labels") == len(labels)) & (F.col("min_n") >= min_count))
    return _of_wells(f, passing, wells, classes)


def spec_wells_relaxed(
    df: DataFrame,
    labels: Sequence[str],
    min_labels: float | None = None,
    min_count: int = MIN_COUNT,
    since: str | None = None,
    classes: Sequence[str] | None = None,
    wells: DataFrame | None = None,
) -> DataFrame:
    """Relaxed screen (J5): at least ``min_labels`` (default ``len(labels)/2``) distinct labels and every
    *present* label at least ``min_count`` times."""
    if min_labels is None:
        min_labels = len(labels) / 2
    f = _prefilter(df, labels, since, classes if wells is None else None, False)
    passing = _label_stats(f).filter((F.col("n_labels") >= F.lit(float(min_labels))) & (F.col("min_n") >= min_count))
    return _of_wells(f, passing, wells, classes)


def label_bit(labels: Sequence[str], col: str | Column = "parlabel") -> Column:
    """``1 << position`` of the label in ``labels`` (0 for other labels)."""
    if len(labels) > 62:
        raise ValueError("at most 62 labels fit a BIGINT mask")
    c = F.col(col) if isinstance(col, str) else col
    pos = F.array_position(F.array(*[F.lit(x) for x in labels]), c)
    one = F.lit(1).cast("bigint")
    return F.when(pos > 0, F.call_function("shiftleft", one, (pos - 1).cast("int"))).otherwise(F.lit(0).cast("bigint"))


def visit_masks(df: DataFrame, labels: Sequence[str], keys: Sequence[str] = ("wid", "logdate")) -> DataFrame:
    """One row per visit with the bit mask of the listed labels it holds."""
    labels = list(dict.fromkeys(labels))
    return df.groupBy(*keys).agg(F.bit_or(label_bit(labels)).alias("mask"))


def visits_with_all(df: DataFrame, labels: Sequence[str], keys: Sequence[str] = ("wid", "logdate")) -> DataFrame:
    """Rows of the visits (well, date) whose label set contains every listed label."""
    labels = list(dict.fromkeys(labels))
    present = contaminant_filter(df, labels).groupBy(*keys, "parlabel").agg(F.count(F.lit(1)).alias("_n"))
    passing = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") == len(labels))
    return df.join(passing.select(*keys), list(keys), "left_semi")
