"""Provider normalisers: parsed provider columns → the canonical logical tables.

Each function takes the output of ``ingest.parse_delimited`` (text columns named as in the provider's
header, plus ``path, member, line_no``) and returns canonical lower-case columns, typed, with the
ingest order (``source_rank, path, line_no``) that keep-first de-duplication needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date_text
from ..functions.ids import make_wid, strip_spaces
from ..functions.geometry import utm_xy
from ..params import AREAS6, UTM_ZONE
from .ingest import area_from_path, to_double, well_formed

# Provider header columns (fixed values: the providers' published field names).
EDF_SAMPLE_COLS = ["GLOBAL_ID", "FIELD_PT_NAME", "PARLABEL", "PARVAL", "PARVQ", "REPDL", "UNITS", "LOGDATE"]
GAMA_SAMPLE_COLS = [
    "GM_WELL_ID", "GM_CHEMICAL_VVL", "GM_RESULT_MODIFIER", "GM_RESULT", "GM_RESULT_UNITS", "GM_REPORTING_LIMIT",
    "GM_SAMP_COLLECTION_DATE",
]
EDF_LOCATION_COLS = ["GLOBAL_ID", "FIELD_PT_NAME", "FIELD_PT_CLASS", "LATITUDE", "LONGITUDE"]
GAMA_LOCATION_COLS = ["GM_WELL_ID", "GM_WELL_CATEGORY", "GM_LATITUDE", "GM_LONGITUDE"]
GAMA_DTW_COLS = ["WELL NUMBER", "DEPTH TO WATER", "MEASUREMENT DATE"]
EDF_DTW_COLS = ["GLOBAL_ID", "FIELD_POINT_NAME", "DTW", "GW_MEAS_DATE"]
GEO_UST_COLS = ["FACILITY_ID", "BUSINESS_NAME", "ADDRESS", "CITY", "ZIP", "COUNTY", "LATITUDE", "LONGITUDE"]
USEPA_UST_COLS = ["Facility_I", "Name", "Address", "City", "County", "Zip_Code", "Latitude", "Longitude", "Open_USTs"]
# parse with CLEANUP_FILE_COLS to get the sites' coordinates too
CLEANUP_COLS = ["GLOBAL_ID", "BUSINESS_NAME", "STREET_NUMBER", "STREET_NAME", "CITY", "ZIP", "CASE_TYPE", "STATUS"]
CLEANUP_FILE_COLS = [*CLEANUP_COLS, "LATITUDE", "LONGITUDE"]

GEOTRACKER_RANK = 0
GAMA_RANK = 1


def _order(df: DataFrame, rank: int, source: str) -> list:
    return [F.lit(source).alias("source"), F.lit(rank).alias("source_rank"), F.col("path"), F.col("line_no")]


def edf_samples(parsed: DataFrame, areas: Sequence[str] = AREAS6) -> DataFrame:
    """First provider's lab results: WID from facility + point name (spaces removed), typed value/limit/date."""
    df = well_formed(parsed)
    return df.select(
        make_wid("GLOBAL_ID", "FIELD_PT_NAME").alias("wid"),
        F.col("PARLABEL").alias("parlabel"),
        to_double("PARVAL").alias("parval"),
        F.col("PARVQ").alias("parvq"),
        to_double("REPDL").alias("repdl"),
        F.col("UNITS").alias("units"),
        parse_date_text("LOGDATE").alias("logdate"),
        *_order(df, GEOTRACKER_RANK, "geotracker"),
        area_from_path("path", areas).alias("area"),
    )


def gama_samples(parsed: DataFrame, areas: Sequence[str] = AREAS6) -> DataFrame:
    """Second provider's results renamed to the first provider's names; WID spaces removed."""
    df = well_formed(parsed)
    return df.select(
        strip_spaces("GM_WELL_ID").alias("wid"),
        F.col("GM_CHEMICAL_VVL").alias("parlabel"),
        to_double("GM_RESULT").alias("parval"),
        F.col("GM_RESULT_MODIFIER").alias("parvq"),
        to_double("GM_REPORTING_LIMIT").alias("repdl"),
        F.col("GM_RESULT_UNITS").alias("units"),
        parse_date_text("GM_SAMP_COLLECTION_DATE").alias("logdate"),
        *_order(df, GAMA_RANK, "gama"),
        area_from_path("path", areas).alias("area"),
    )


def edf_locations(parsed: DataFrame) -> DataFrame:
    df = well_formed(parsed)
    return df.select(
        make_wid("GLOBAL_ID", "FIELD_PT_NAME").alias("wid"),
        F.col("FIELD_PT_CLASS").alias("field_pt_class"),
        to_double("LATITUDE").alias("latitude"),
        to_double("LONGITUDE").alias("longitude"),
        *_order(df, GEOTRACKER_RANK, "geotracker"),
    )


def gama_locations(parsed: DataFrame) -> DataFrame:
    """Second provider's wells; the id keeps its spaces, as in the reference (see ``normalize_wid``)."""
    df = well_formed(parsed)
    return df.select(
        F.col("GM_WELL_ID").alias("wid"),
        F.col("GM_WELL_CATEGORY").alias("field_pt_class"),
        to_double("GM_LATITUDE").alias("latitude"),
        to_double("GM_LONGITUDE").alias("longitude"),
        *_order(df, GAMA_RANK, "gama"),
    )


def gama_dtw(parsed: DataFrame) -> DataFrame:
    df = well_formed(parsed)
    return df.select(
        strip_spaces("WELL NUMBER").alias("wid"),
        to_double("DEPTH TO WATER").alias("dtw"),
        parse_date_text("MEASUREMENT DATE").alias("logdate"),
        *_order(df, GAMA_RANK, "gama"),
    )


def edf_dtw(parsed: DataFrame) -> DataFrame:
    df = well_formed(parsed)
    return df.select(
        make_wid("GLOBAL_ID", "FIELD_POINT_NAME").alias("wid"),
        to_double("DTW").alias("dtw"),
        parse_date_text("GW_MEAS_DATE").alias("logdate"),
        *_order(df, GEOTRACKER_RANK, "geotracker"),
    )


def _planar(lat=None, lon=None) -> list:
    """UTM metres (the zone of the study area) of a site's latitude and longitude."""
    lat = to_double("LATITUDE") if lat is None else lat
    lon = to_double("LONGITUDE") if lon is None else lon
    x, y = utm_xy(lon, lat, UTM_ZONE)
    return [x.alias("x_m"), y.alias("y_m")]


def geotracker_usts(parsed: DataFrame) -> DataFrame:
    """Permitted tanks, renamed to the federal layer's names; one open tank per record."""
    df = well_formed(parsed)
    return df.select(
        F.col("FACILITY_ID").alias("Facility_I"),
        F.col("BUSINESS_NAME").alias("Name"),
        F.col("ADDRESS").alias("Address"),
        F.col("CITY").alias("City"),
        F.col("ZIP").alias("Zip_Code"),
        F.col("COUNTY").alias("County"),
        to_double("LATITUDE").alias("Latitude"),
        to_double("LONGITUDE").alias("Longitude"),
        F.lit(1.0).alias("Open_USTs"),
        *_planar(),
        F.lit(GEOTRACKER_RANK).alias("source_rank"),
        F.col("path"),
        F.col("line_no"),
    )


def usepa_usts(df: DataFrame) -> DataFrame:
    """Federal tank layer (exported to Parquet/CSV): keep only the listed columns that exist, with planar
    coordinates. Without a ``line_no`` of its own the layer is ordered by what its rows hold."""
    keep = [c for c in USEPA_UST_COLS if c in df.columns]
    out = df.select(*keep)
    for c in ("Latitude", "Longitude", "Open_USTs"):
        if c in out.columns:
            out = out.withColumn(c, to_double(F.col(c).cast("string")))
    extra = [F.lit(GAMA_RANK).alias("source_rank")]
    if "Latitude" in out.columns and "Longitude" in out.columns:
        extra += _planar(F.col("Latitude"), F.col("Longitude"))
    if "path" not in out.columns:
        extra += [F.lit("usepa").alias("path"), F.xxhash64(*keep).alias("line_no")]
    return out.select("*", *extra)


def cleanup_sites(parsed: DataFrame) -> DataFrame:
    """Cleanup sites with planar coordinates (NULL where the file has none)."""
    df = well_formed(parsed)
    have = {"LATITUDE", "LONGITUDE"} <= set(df.columns)
    nowhere = F.lit(None).cast("double")
    planar = _planar() if have else [nowhere.alias("x_m"), nowhere.alias("y_m")]
    return df.select(*CLEANUP_COLS, *planar, "path", "line_no")
