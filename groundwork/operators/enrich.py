"""Location / limit / unit enrichment, exceedance and magnitude."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import TARGET_UNIT, ZSCORE_MAX
from .clean import DEFAULT_ORDER, keep_first
from .joins import splittable_join, with_row_no

LOCATION_COLS = ("wid", "field_pt_class", "latitude", "longitude")


def join_locations(samples: DataFrame, locations: DataFrame, how: str = "inner",
                   cols: Sequence[str] = LOCATION_COLS) -> DataFrame:
    """Attach the (de-duplicated) well location to every sample.

    ``locations`` has one row per well and grows with the data, so no broadcast hint: AQE turns the
    sort-merge join into a broadcast join at run time when the well table is small, and splits the partition
    of a well that holds many samples otherwise (``splittable_join``), provided that nothing above the join groups by
    the well without an exchange of its own: per-well results are aggregated first and joined afterwards (see
    ``score.wells_with_mag``).
    """
    loc = locations.select(*[c for c in cols if c in locations.columns])
    return splittable_join(samples, loc, "wid", how)


def join_mcl(samples: DataFrame, mcl: DataFrame, how: str = "inner") -> DataFrame:
    """Attach the contaminant limit by label (D2 inner / D3 left); the limit's unit becomes ``mcl_units``."""
    m = with_row_no(mcl, "_mcl_row").select(
        F.col("chem_abrv"), F.col("chem_name"), F.col("comp_conc_val"), F.col("comp_conc_type"),
        F.col("units").alias("mcl_units"), "_mcl_row",
    )
    out = samples.join(m, samples["parlabel"] == m["chem_abrv"], how)
    return out.drop("chem_abrv")


def convert_units(samples: DataFrame, units: DataFrame, target_unit: str = TARGET_UNIT) -> DataFrame:
    """Multiply the value by the factor of its unit where the sample unit differs from the limit's unit,
    then label every row ``target_unit`` (B10, D4).

    The unit join is inner: rows whose unit is not in the table (or is NULL) drop out. A unit table
    holding one unit twice fans the row out, as in the reference; ``dedup_after`` in
    ``enrich_samples`` undoes that.
    """
    u = with_row_no(units, "_unit_row").select("start_unit", "coef", "_unit_row")
    out = samples.join(u, samples["units"] == u["start_unit"], "inner")
    differs = F.col("units") != F.col("mcl_units")
    conv = F.when(differs, F.col("parval") * F.col("coef")).otherwise(F.col("parval"))
    # The factor converts the sample to the target unit, which only matches the limit when the limit is
    # in that unit; a converted sample compared with a limit in another unit is off by the factor.
    mismatch = F.coalesce(differs & (F.col("mcl_units") != F.lit(target_unit)), F.lit(False))
    return out.withColumn("parval", conv).withColumn("unit_mismatch", mismatch).withColumn("units", F.lit(target_unit))


def exceedence_magnitude(df: DataFrame, value: str = "parval", limit: str = "comp_conc_val") -> DataFrame:
    """``exceedence = value > limit``; ``magnitude = value / limit - 1`` (NULL for a zero limit)."""
    return df.withColumn("exceedence", F.col(value) > F.col(limit)).withColumn(
        "magnitude", F.try_divide(F.col(value), F.col(limit)) - F.lit(1.0)
    )


def enrich_samples(
    samples: DataFrame,
    locations: DataFrame | None,
    mcl: DataFrame,
    units: DataFrame,
    dedup_after: bool = False,
    target_unit: str = TARGET_UNIT,
    order: Sequence[str] = DEFAULT_ORDER,
    flag_unit_mismatch: bool = False,
    keep_units: bool = False,
) -> DataFrame:
    """Locations ⋈ limits ⋈ unit factors → converted value, exceedance flag and magnitude.

    ``dedup_after=True`` (the all-samples job, J3) keeps one row per sample id after the unit join: of
    the rows a doubled lookup entry makes, the one of the entry that stands first in its table. A lookup
    table without ``row_no`` has no such order; its values then break the tie.
    ``keep_units=True`` keeps ``mcl_units``, the limit's own unit (the key of the water-quality pivot).
    ``flag_unit_mismatch=True`` keeps the ``unit_mismatch`` column: rows whose ratio is off because the
    sample was converted to the target unit but the limit is stated in another unit (the reference
    labels such rows with the target unit all the same).
    """
    # the broadcast lookups go first: they drop unlisted chemicals and units map-side, so the location
    # join (the one that can shuffle) only moves rows that survive (inner joins commute)
    df = join_mcl(samples, mcl)
    df = convert_units(df, units, target_unit)
    if dedup_after:
        ties = ["_mcl_row", "_unit_row", "comp_conc_val", "chem_name", "mcl_units", "comp_conc_type", "coef"]
        df = keep_first(df, ["wid", "logdate", "parlabel"], [*order, *ties])
    if locations is not None:  # one row per well, so the join commutes with keep-first
        df = join_locations(df, locations)
    df = df.drop("repdl", "comp_conc_type", "start_unit", "coef", "_mcl_row", "_unit_row")
    if not keep_units:
        df = df.drop("mcl_units")
    if not flag_unit_mismatch:
        df = df.drop("unit_mismatch")
    return exceedence_magnitude(df)


def restrict_to_listed(raw: DataFrame, mcl: DataFrame) -> DataFrame:
    """Keep only samples whose label has a limit, *before* de-duplication.

    Legal because the label is part of the sample id: dropping other labels never changes which row is
    kept for a listed one.
    """
    return raw.join(mcl.select(F.col("chem_abrv").alias("parlabel")).distinct(), "parlabel", "left_semi")


def exceedance_ratios(samples: DataFrame, mcl: DataFrame) -> DataFrame:
    """Exceedances only, with ``mag = value / limit`` (B13, C6); no unit conversion, as in the scoring job."""
    df = join_mcl(samples, mcl)
    df = df.filter(F.col("parval") > F.col("comp_conc_val"))
    return df.withColumn("mag", F.try_divide(F.col("parval"), F.col("comp_conc_val")))


def zscore_outliers(df: DataFrame, col: str = "mag", max_abs_z: float = ZSCORE_MAX) -> DataFrame:
    """Drop rows whose population z-score of ``col`` exceeds ``max_abs_z`` (C11; threshold is our choice).

    NULL values have no z-score and are dropped; where all values are equal every z-score is 0. Mean and
    deviation are one scalar subquery: no join, and no job while planning.
    """
    stats = df.agg(F.struct(F.avg(col).alias("mu"), F.stddev_pop(col).alias("sd"))).scalar()
    z = F.when(stats["sd"] == 0, F.lit(0.0)).otherwise((F.col(col) - stats["mu"]) / stats["sd"])
    return df.filter(F.col(col).isNotNull() & (F.abs(z) <= F.lit(max_abs_z)))
