"""Expected-file manifest per area and the files still missing (re-aimed downloader, A20).

Downloading is single-machine network I/O and is not rebuilt; what the jobs need from it is the list
of files each area should have, and which of them have not landed yet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import EDF_SUFFIX, GAMA_DATASETS, GAMA_PREFIX, GAMA_SUFFIX, GEOXY_SUFFIX


def source_manifest_for_areas(areas: DataFrame, datasets: Sequence[str] = GAMA_DATASETS, area_col: str = "area") -> DataFrame:
    """One row per (area, dataset) with the expected file name.

    Area-level datasets: ``<Area>EDF.zip`` (lab results) and ``<Area>GeoXY.zip`` (locations) of the first
    provider, and ``gama_<dataset><area lower>_v2.zip`` per dataset of the second. The dataset list is
    exploded per area row (no cross join).
    """
    kinds = [F.struct(F.lit("edf").alias("dataset"), F.lit("").alias("prefix"), F.lit(EDF_SUFFIX).alias("suffix"), F.lit(False).alias("lower"))]
    kinds.append(F.struct(F.lit("geoxy").alias("dataset"), F.lit("").alias("prefix"), F.lit(GEOXY_SUFFIX).alias("suffix"), F.lit(False).alias("lower")))
    for ds in datasets:
        kinds.append(
            F.struct(F.lit(ds).alias("dataset"), F.lit(GAMA_PREFIX + ds).alias("prefix"), F.lit(GAMA_SUFFIX).alias("suffix"), F.lit(True).alias("lower"))
        )
    e = areas.select(F.col(area_col).alias("area"), F.explode(F.array(*kinds)).alias("k"))
    name = F.concat(
        F.col("k.prefix"), F.when(F.col("k.lower"), F.lower(F.col("area"))).otherwise(F.col("area")), F.col("k.suffix")
    )
    return e.select("area", F.col("k.dataset").alias("dataset"), name.alias("file_name"))


def missing_sources(manifest: DataFrame, landed: DataFrame, path_col: str = "path") -> DataFrame:
    """Manifest rows whose file has not landed (matched on the file's base name)."""
    names = landed.select(F.regexp_extract(F.col(path_col), r"([^/\\]+)$", 1).alias("file_name"))
    return manifest.join(names, "file_name", "left_anti")
