"""End-to-end jobs: what the reference's per-county scripts do, as Spark jobs over all areas at once.

Every job takes DataFrames (or landing folders) and, when given an ``out`` folder, writes its result
with ``groundwork.sinks`` and returns the written table read back, so the next job starts from files
(lineage cut, as the reference's CSV hand-offs between scripts) instead of recomputing upstream.

| job | reference script | steps |
| --- | --- | --- |
| ``load_samples`` / ``load_locations`` / ``load_dtw`` | loaders | land zips → parse → normalise → union |
| ``clean_enrich_job`` | clean-samples / all-samples batch | J1 → J2 (→ J3 with ``dedup_after``) |
| ``dtw_job`` | elevation notebook | J6 (+ J7 extract) |
| ``spec_job`` | spec-samples batch, parameter test | J4 / J5 |
| ``combo_job`` | combination notebook | J8 |
| ``score_job`` | block scoring script | J10 → J11 |
| ``study_area_job`` | study-area notebook | J14 → J15 |
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .. import operators as op
from .. import sinks
from ..params import AREAS6, CONTS11, DEFAULT_SINCE, MIN_COUNT, MONITORING_CLASSES, PROXIMITY_RADIUS_M, UTM_ZONE, WQI_COLUMNS
from ..sources import ingest, providers, zips


def _out(df: DataFrame, out: str | None, name: str, by_area: bool = False) -> DataFrame:
    if out is None:
        return df
    path = f"{out.rstrip('/')}/{name}"
    if by_area and "area" in df.columns:
        sinks.write_by_area(df, path)
    else:
        sinks.write_table(df, path)
    # read back with the known schema: an empty result leaves no data files to infer it from
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _landed(spark: SparkSession, root: str, glob: str = "*.zip", areas: Sequence[str] | None = None) -> DataFrame:
    """Records of the undamaged archives under a folder: of an archive with a damaged member nothing gets in."""
    return zips.whole_archives(zips.land_records(spark, root, glob, areas))


# --- loaders ---------------------------------------------------------------------------------------


def load_samples(spark: SparkSession, edf_root: str | None, gama_root: str | None,
                 areas: Sequence[str] = AREAS6) -> DataFrame:
    """All lab results of both providers under the two landing folders (A2–A5, H1, H2)."""
    parts = []
    if edf_root:
        lines = _landed(spark, edf_root, areas=areas)
        parts.append(providers.edf_samples(ingest.parse_delimited(lines, providers.EDF_SAMPLE_COLS), areas))
    if gama_root:
        lines = _landed(spark, gama_root, areas=areas)
        parts.append(providers.gama_samples(ingest.parse_delimited(lines, providers.GAMA_SAMPLE_COLS), areas))
    return op.union_all(*parts)


def load_locations(spark: SparkSession, edf_xy_root: str | None, gama_xy_root: str | None,
                   normalize_wid: bool = False, areas: Sequence[str] | None = None) -> DataFrame:
    """Well locations of both providers, one row per well, first provider first.

    With ``areas`` the first provider's files are picked by area, as the batch picks them by county; the second
    provider has one file for all."""
    parts = []
    if edf_xy_root:
        lines = _landed(spark, edf_xy_root, areas=areas)
        parts.append(providers.edf_locations(ingest.parse_delimited(lines, providers.EDF_LOCATION_COLS)))
    if gama_xy_root:
        lines = _landed(spark, gama_xy_root)
        parts.append(providers.gama_locations(ingest.parse_delimited(lines, providers.GAMA_LOCATION_COLS)))
    return op.dedup_locations(op.union_all(*parts), normalize_wid=normalize_wid)


def load_dtw(spark: SparkSession, elevation_root: str) -> DataFrame:
    """Depth-to-water readings of both providers from one folder (``*Geo*.zip`` / ``*gama*.zip``)."""
    geo = ingest.parse_delimited(_landed(spark, elevation_root, "*Geo*.zip"), providers.EDF_DTW_COLS)
    gama = ingest.parse_delimited(_landed(spark, elevation_root, "*gama*.zip"), providers.GAMA_DTW_COLS)
    return op.dtw_union(providers.edf_dtw(geo), providers.gama_dtw(gama))


# --- jobs ------------------------------------------------------------------------------------------


def clean_enrich_job(samples_raw: DataFrame, locations: DataFrame, mcl: DataFrame, units: DataFrame,
                     out: str | None = None, dedup_after: bool = False, since: str | None = None,
                     labels: Sequence[str] | None = None, counts: op.StageCounts | None = None) -> DataFrame:
    """J1 + J2 (+ J3 when ``dedup_after``/``since``/``labels`` are given): clean, enrich, write by area.

    ``counts`` takes the rows of each stage along while the result is written (``raw, listed, clean, enriched,
    result``)."""
    mark = counts.mark if counts is not None else (lambda df, stage: df)
    listed = mark(op.restrict_to_listed(mark(samples_raw, "raw"), mcl), "listed")
    clean = mark(op.clean_samples(listed, with_ids=False), "clean")
    df = mark(op.enrich_samples(clean, locations, mcl, units, dedup_after=dedup_after), "enriched")
    df = op.since_filter(df, since)
    if labels:
        df = op.contaminant_filter(df, labels)
    df = mark(df, "result")
    return _out(df, out, "samples_enriched", by_area=True)


def dtw_job(enriched: DataFrame, dtw: DataFrame, out: str | None = None,
            labels: Sequence[str] = CONTS11) -> tuple[DataFrame, DataFrame]:
    """J6 (samples ⟕ readings) and J7 (monitoring-well extract with a reading)."""
    joined = _out(op.attach_dtw(enriched, dtw, "left"), out, "samples_dtw", by_area=True)
    extract = _out(op.all_dtw(joined, labels), out, "all_dtw", by_area=True)
    return joined, extract


def spec_job(samples: DataFrame, labels: Sequence[str] = CONTS11, since: str = DEFAULT_SINCE,
             min_count: int = MIN_COUNT, relaxed: bool = False, require_dtw: bool = False,
             classes: Sequence[str] | None = None, out: str | None = None) -> DataFrame:
    """J4 strict (or J5 relaxed) well screen, written by area."""
    if relaxed:
        df = op.spec_wells_relaxed(samples, labels, min_count=min_count, since=since, classes=classes)
    else:
        df = op.spec_wells(samples, labels, since=since, min_count=min_count, require_dtw=require_dtw,
                           classes=classes)
    return _out(df, out, "spec_samples", by_area=True)


def combo_job(samples: DataFrame, labels: Sequence[str] = CONTS11, sizes: Sequence[int] = range(4, 12),
              since: str = DEFAULT_SINCE, classes: Sequence[str] | None = MONITORING_CLASSES,
              min_count: int = MIN_COUNT, by_area: bool = True, out: str | None = None) -> dict[str, DataFrame]:
    """Combination statistics, per-size maxima and per-size column maxima.

    ``by_area=True`` mines each area separately (the reference runs one county per notebook) in one
    job: the area is part of every grouping key.
    """
    f = op.since_filter(samples, since)
    if classes:
        f = op.monitoring_wells(f, classes)
    f = op.contaminant_filter(f, labels)
    g = ["area"] if by_area and "area" in f.columns else []
    stats = _out(op.by_wells(op.combo_stats(f, labels, sizes, min_count, g), g), out, "combo_stats")
    return {
        "stats": stats,
        "max": _out(op.combo_max(stats, g), out, "combo_max"),
        "groups": _out(op.combo_groups(stats, g), out, "combo_groups"),
    }


def frequent_combo_job(samples: DataFrame, min_wells: int, labels: Sequence[str] | None = None, sizes: Sequence[int] | None = None,
                       since: str = DEFAULT_SINCE, classes: Sequence[str] | None = MONITORING_CLASSES,
                       min_count: int = MIN_COUNT, by_area: bool = True, out: str | None = None) -> DataFrame:
    """J8 without a list of combinations: those of any number of labels that ``min_wells`` wells (of an area) hold."""
    f = op.since_filter(samples, since)
    if classes:
        f = op.monitoring_wells(f, classes)
    g = ["area"] if by_area and "area" in f.columns else []
    if g:
        f = f.filter(f["area"].isNotNull())
    found = op.frequent_combos(op.label_sets(f, ["wid"], labels, min_count, g), min_wells, sizes, g)
    return _out(found, out, "frequent_combos")


def pivot_job(samples_raw: DataFrame, locations: DataFrame, mcl: DataFrame, units: DataFrame,
              columns: Sequence[str] = WQI_COLUMNS, date_grain: str | None = None, out: str | None = None) -> DataFrame:
    """Complete (station, date) rows of mean converted values, one column per label and limit unit."""
    clean = op.clean_samples(op.restrict_to_listed(samples_raw, mcl), with_ids=False)
    converted = op.enrich_samples(clean, locations, mcl, units, keep_units=True)
    return _out(op.wqi_pivot(converted, columns, date_grain), out, "wqi_pivot")


def score_job(samples_raw: DataFrame, locations: DataFrame, blocks: DataFrame, mcl: DataFrame,
              since: str = DEFAULT_SINCE, method: str = "gmean", geometry: str = "polygon",
              radius: float = PROXIMITY_RADIUS_M, zone: int = UTM_ZONE, zscore: float | None = None,
              out: str | None = None, geographic_blocks: bool = False) -> tuple[DataFrame, DataFrame]:
    """J10 + J11: detections since ``since`` → keep-max per sample → exceedance ratios (optional z-score
    cut) → per-well geometric mean → wells projected to UTM → distance-weighted block scores.

    ``blocks`` carries ``geoid`` and either ``rings`` (``geometry='polygon'``; in UTM metres, or in degrees
    with ``geographic_blocks=True``, then projected like the wells) or ``x_m, y_m`` (``'point'``).
    Returns (wells, scores).
    """
    if geographic_blocks:
        blocks = op.project_utm(blocks, zone=zone)
    det = op.clean_samples(op.detects(op.restrict_to_listed(samples_raw, mcl), since=since), with_ids=False)
    ratios = op.exceedance_ratios(det, mcl)
    if zscore is not None:
        ratios = op.zscore_outliers(ratios, "mag", zscore)
    mags = op.well_magnitude(ratios, "gmean", "mag")
    wells = op.project_utm(op.wells_with_mag(locations.select("wid", "latitude", "longitude"), mags), zone=zone)
    wells = _out(wells, out, "wells")
    scores = op.block_score(blocks, wells, method, radius, geometry=geometry)
    if out is not None:  # the layers other tools read: wells as points, blocks with their geometry
        sinks.write_wells_layer(wells, f"{out.rstrip('/')}/wells_layer")
        sinks.write_block_scores(scores, f"{out.rstrip('/')}/blocks_layer", blocks)
    return wells, _out(scores, out, "block_scores")


def study_area_job(blockgroups: DataFrame, usts: Sequence[DataFrame], cleanups: DataFrame,
                   top_fraction: float = 0.25, max_depth: float = 5.0, out: str | None = None) -> DataFrame:
    """J14 + J15: tank inventory (one per address), site counts per block group, top fraction, shallow
    water table, disadvantaged community."""
    tanks = op.ust_union(*usts)
    counts = op.blockgroup_site_counts(blockgroups, tanks, cleanups)
    counts = _out(counts, out, "blockgroup_site_counts")
    return _out(op.study_area(counts, top_fraction, max_depth), out, "study_area")
