"""DataFrame -> DataFrame operators (usable with ``df.transform``)."""

from .adaptive import adaptive_point_pairs
from .clean import clean_samples, dedup_locations, flag_first, head_per_group, keep_first, require, union_all
from .combos import by_wells, combinations_table, combo_groups, combo_max, combo_stats, visit_combo_best, visit_combo_support
from .depth import all_dtw, attach_dtw, dtw_coverage, dtw_union
from .enrich import (
    convert_units,
    enrich_samples,
    exceedance_ratios,
    exceedence_magnitude,
    join_locations,
    join_mcl,
    restrict_to_listed,
    zscore_outliers,
)
from .levelwise import frequent_combos, label_sets
from .pivot import wqi_pivot
from .score import block_score, project_utm, weighted_pairs, well_magnitude, wells_with_mag
from .ranks import percent_rank_by_ranges
from .screen import (
    contaminant_filter,
    detects,
    monitoring_wells,
    since_filter,
    spec_wells,
    spec_wells_relaxed,
    visits_with_all,
)
from .sites import blockgroup_site_counts, rank_fraction_desc, study_area, ust_union
from .spatial import point_pairs, points_in_polygons, polygon_pairs, proximity_pairs
from .stats import StageCounts, class_counts, label_counts, label_lists, label_percent, stage_counts, stage_counts_flagged, top_labels
