"""Storage tanks, cleanup sites and study-area selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import STUDY_MAX_DEPTH_M, STUDY_TOP_FRACTION
from .clean import DEFAULT_ORDER, keep_first, union_all
from .spatial import points_in_polygons

UST_COLS = ("Facility_I", "Name", "Address", "City", "County", "Zip_Code", "Latitude", "Longitude", "Open_USTs")


def ust_union(*providers: DataFrame, order=DEFAULT_ORDER) -> DataFrame:
    """One tank record per address: the one with the most open tanks (NULL counts last), ties by
    provider order then ingest order. A NULL address is one group (F4)."""
    df = union_all(*providers)
    return keep_first(df, ["Address"], order, first=[F.col("Open_USTs").desc_nulls_last()])


def blockgroup_site_counts(blockgroups: DataFrame, usts: DataFrame, cleanups: DataFrame, cell: float = 1000.0) -> DataFrame:
    """Tanks + cleanup sites inside each block group (E18); groups with none get 0.

    Both point sets go through ONE containment join (tagged by kind), so the block-group polygons are
    exploded to grid cells once. Columns: every block-group column except the rings, plus ``usts,
    cleanups, sites``.
    """
    pts = usts.select(F.col("Facility_I").cast("string").alias("_pid"), "x_m", "y_m", F.lit("ust").alias("_kind")).unionByName(
        cleanups.select(F.col("GLOBAL_ID").cast("string").alias("_pid"), "x_m", "y_m", F.lit("cleanup").alias("_kind"))
    )
    hits = points_in_polygons(blockgroups, pts, "_pid", cell, point_cols=("_kind",))
    n = hits.groupBy("geoid").agg(
        F.count_if(F.col("_kind") == "ust").alias("usts"), F.count_if(F.col("_kind") == "cleanup").alias("cleanups")
    )
    out = blockgroups.drop("rings").join(n, "geoid", "left")
    out = out.withColumn("usts", F.coalesce("usts", F.lit(0)).cast("bigint"))
    out = out.withColumn("cleanups", F.coalesce("cleanups", F.lit(0)).cast("bigint"))
    return out.withColumn("sites", F.col("usts") + F.col("cleanups"))


def rank_fraction_desc(df: DataFrame, col: str, out: str = "pct_rank") -> DataFrame:
    """``percent_rank() over (order by col desc)`` without a global single-partition window.

    ``pct_rank = (rows with a larger value) / (N - 1)``. The running count runs over the histogram of
    distinct values of ``col``, not over the rows, and is joined back by value. ``col`` is meant to be a
    non-negative count: k distinct counts need at least 0+1+…+(k-1) items, so k <= sqrt(2 * total) + 1
    (about 4,500 rows for ten million sites). Spark picks the join from the histogram's run-time size.
    """
    hist = df.groupBy(col).agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy(F.col(col).desc()).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    hist = hist.select(
        col,
        F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_greater"),
        F.sum("_cnt").over(total).alias("_n"),
    )
    hist = hist.select(
        col,
        F.when(F.col("_n") <= 1, F.lit(0.0)).otherwise(F.col("_greater") / (F.col("_n") - 1)).alias(out),
    )
    return df.join(hist, col, "left")


def study_area(
    counts: DataFrame,
    top_fraction: float = STUDY_TOP_FRACTION,
    max_depth: float = STUDY_MAX_DEPTH_M,
) -> DataFrame:
    """Top ``top_fraction`` of block groups by site count (``percent_rank <= top_fraction``), with a water
    table at most ``max_depth`` metres deep, inside a disadvantaged community (J15; defaults our choice)."""
    ranked = rank_fraction_desc(counts, "sites")
    return ranked.filter(F.col("pct_rank") <= F.lit(float(top_fraction))).filter(
        (F.col("water_table_depth_m") <= F.lit(float(max_depth))) & F.col("is_dac")
    )
