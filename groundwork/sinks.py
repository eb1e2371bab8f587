"""Result sinks (K1–K3): Parquet (or CSV) tables, partitioned by area where the jobs are per area.

The reference writes one CSV per county per step. Here one job writes all areas at once with
``partitionBy('area')`` so later reads prune to the areas they need, and the well / block layers are
plain columns (projected metres) instead of shapefiles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import ensure_checkpoint_dir
from .sources.shapes import wkb_from_rings


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: str | list[str] | None = None, sort_by: list[str] | None = None) -> None:
    """Write ``df``; ``sort_by`` orders rows inside each output file (sorted by id, as the reference's
    layers are, without a global sort: ``sortWithinPartitions`` adds no shuffle)."""
    if partition_by:
        # one exchange that gathers each folder's rows in few, evenly sized files (Spark splits large
        # ones); without it every task would write a file in every folder
        df = df.hint("rebalance", *([partition_by] if isinstance(partition_by, str) else partition_by))
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)


def write_ordered(df: DataFrame, path: str, order_by: list[str], index: str | None = None, fmt: str = "parquet",
                  mode: str = "overwrite", descending: bool = False) -> None:
    """Write ``df`` in one global order over all its files, with a running number from 0 as ``index``.

    Rows are range-partitioned and sorted, and files are named in the order of the ranges. For the index the ordered rows
    are first written to the shared scratch folder with their place inside their range, so that ranges and places are
    settled; the ranges' counts (one row per range) then give each its start. Rows that tie in ``order_by`` stand in any order.
    """
    spark = df.sparkSession
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in order_by]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    w = lambda d: d.write.mode(mode).format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)
    if index is None:
        return w(placed)
    scratch = f"{ensure_checkpoint_dir(spark).rstrip('/')}/groundwork-ordered/{uuid.uuid4().hex}"
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(scratch)
    at = spark.read.schema(placed.schema).parquet(scratch).withColumn("_range", F.shiftright("_at", 33))
    ranges = at.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranges.select("_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = at.join(starts, "_range").select((F.col("_at") + F.col("_shift")).alias(index), *df.columns)
    w(numbered.repartitionByRange(index).sortWithinPartitions(index))


def write_by_area(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Per-area result files (K1): one directory per area value."""
    write_table(df, path, fmt, mode, partition_by="area")


def write_wells_layer(wells: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Well layer (K2): id, magnitude and projected coordinates (EPSG:26911 metres)."""
    cols = [c for c in ("wid", "mag", "latitude", "longitude", "x_m", "y_m") if c in wells.columns]
    write_table(wells.select(*cols), path, "parquet", mode, sort_by=["wid"])


def write_block_scores(scores: DataFrame, path: str, blocks: DataFrame | None = None, mode: str = "overwrite") -> None:
    """Scored blocks (K3); with ``blocks`` (``geoid, rings`` or ``geoid, x_m, y_m``) their geometry goes along,
    polygons as WKB."""
    if blocks is not None:
        shape = [wkb_from_rings("rings").alias("geometry")] if "rings" in blocks.columns else ["x_m", "y_m"]
        scores = scores.join(blocks.select("geoid", *shape), "geoid", "left")
    write_table(scores, path, "parquet", mode, sort_by=["geoid"])
