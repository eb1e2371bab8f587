"""Per-well magnitudes and distance-weighted block scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import rings_utm, utm_xy
from ..functions.weights import band_weight, gmean
from ..params import DISTANCE_BANDS, PROXIMITY_RADIUS_M, UTM_ZONE
from .spatial import point_pairs, polygon_pairs


def well_magnitude(df: DataFrame, method: str = "mean", value: str = "magnitude") -> DataFrame:
    """Per well: arithmetic (``'mean'``, E1) or geometric (``'gmean'``, E2) mean of ``value`` → ``wid, mag``."""
    agg = F.avg(value) if method == "mean" else gmean(value)
    if method not in ("mean", "gmean"):
        raise ValueError(f"unknown method {method!r}")
    return df.groupBy("wid").agg(agg.alias("mag"))


def wells_with_mag(locations: DataFrame, mags: DataFrame) -> DataFrame:
    """Wells that have a magnitude, with their location (D7 inner join)."""
    return locations.join(mags, "wid", "inner")


def project_utm(df: DataFrame, lon: str = "longitude", lat: str = "latitude", zone: int = UTM_ZONE) -> DataFrame:
    """Add ``x_m, y_m`` (UTM metres, GRS80/NAD83, fixed zone) from geographic columns (B20, B21);
    of a polygon table (``rings`` in degrees) the rings are projected instead."""
    if "rings" in df.columns:
        return df.withColumn("rings", rings_utm("rings", zone))
    x, y = utm_xy(lon, lat, zone)
    return df.withColumn("x_m", x).withColumn("y_m", y)


def weighted_pairs(pairs: DataFrame, bands=DISTANCE_BANDS) -> DataFrame:
    """``adj = mag * band_weight(dist)`` for every (block, well) pair."""
    return pairs.withColumn("weight", band_weight("dist", bands)).withColumn("adj", F.col("mag") * F.col("weight"))


def block_score(
    blocks: DataFrame,
    wells: DataFrame,
    method: str = "gmean",
    radius: float = PROXIMITY_RADIUS_M,
    bands=DISTANCE_BANDS,
    geometry: str = "point",
    salt: int = 1,
) -> DataFrame:
    """Score every block from the wells within ``radius``.

    ``wells``: ``wid, x_m, y_m, mag``. ``blocks``: ``geoid, x_m, y_m`` (``geometry='point'``) or
    ``geoid, rings`` (``'polygon'``). Score = geometric (E11) or arithmetic (E12) mean of
    ``mag × weight`` over the wells in range; 0 for a block with none (D8). Columns ``geoid, score``.
    """
    if geometry == "point":
        pairs = point_pairs(blocks, wells, radius, salt=salt, well_cols=("wid", "mag"))
    elif geometry == "polygon":
        pairs = polygon_pairs(blocks, wells, radius, salt=salt, well_cols=("wid", "mag"))
    else:
        raise ValueError(f"unknown geometry {geometry!r}")
    w = weighted_pairs(pairs, bands)
    agg = gmean("adj") if method == "gmean" else F.avg("adj")
    scores = w.groupBy("geoid").agg(agg.alias("score"))
    return blocks.select("geoid").join(scores, "geoid", "left").select(
        "geoid", F.coalesce(F.col("score"), F.lit(0.0)).alias("score")
    )
