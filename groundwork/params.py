"""Fixed values and defaults.

The lists under "fixed values" must equal the source analysis for identical results; they are stated
plainly and in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------------
# Fixed values (must match the original analysis)
# ---------------------------------------------------------------------------------------------------

# Volatile organic compounds of interest.
VOCS = ["BZ", "BZME", "DBCP", "EBZ", "EDB", "MTBE", "PCE", "TCE", "TCPR123", "XYLENES"]

# Ten-contaminant screening set.
CONTS10 = ["TCPR123", "CD", "PB", "EDB", "PCE", "TCE", "BZ", "BZME", "EBZ", "XYLENES"]

# Eleven-contaminant screening set (CONTS10 + MTBE).
CONTS11 = ["TCPR123", "CD", "PB", "EDB", "PCE", "TCE", "BZ", "BZME", "EBZ", "XYLENES", "MTBE"]

# BTEX-style four-chemical set used for the monitoring-well screen.
CHEMS4 = ["BZ", "BZME", "EBZ", "MTBE"]

# Counties processed by the batch jobs.
AREAS6 = ["Ventura", "SanDiego", "Kern", "Imperial", "SantaBarbara", "LosAngeles"]

# Well classes that count as monitoring wells.
MONITORING_CLASSES = ["MW", "MONITORING"]

# Distance bands for the proximity weight: (lower bound inclusive, upper bound, weight); the last band's
# upper bound is inclusive.
DISTANCE_BANDS = [(0.0, 250.0, 1.0), (250.0, 500.0, 0.5), (500.0, 750.0, 0.25), (750.0, 1000.0, 0.1)]
PROXIMITY_RADIUS_M = 1000.0

# Column order of the water-quality-index pivot (label_unit keys).
WQI_COLUMNS = [
    "AS_UG/L", "BZME_UG/L", "BZ_UG/L", "CD_UG/L", "DBCP_UG/L", "EBZ_UG/L", "EDB_UG/L", "MTBE_UG/L",
    "NO3N_MG/L", "PB_UG/L", "PCE_UG/L", "TCE_UG/L", "TCPR123_UG/L", "THM_UG/L", "XYLENES_UG/L",
]

# Source datasets published per county by the second provider (file name = prefix + dataset + county + suffix).
GAMA_DATASETS = [
    "ddw_", "dpr_", "dwr_", "gama_dom_", "gama_sp-study_", "gama_usgs_", "localgw_", "usgs_nwis_",
    "wb_cleanup_", "wb_ilrp_", "wrd_",
]
GAMA_PREFIX = "gama_"
GAMA_SUFFIX = "_v2.zip"
EDF_SUFFIX = "EDF.zip"
GEOXY_SUFFIX = "GeoXY.zip"

# Missing-value markers a pandas CSV read treats as NA by default.
NA_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---------------------------------------------------------------------------------------------------
# Defaults (parameters; the batch jobs' values)
# ---------------------------------------------------------------------------------------------------

DEFAULT_SINCE = "2012-01-01"
ALL_SAMPLES_SINCE = "2000-01-01"
MIN_COUNT = 4
TARGET_UNIT = "UG/L"
DTW_UNITS = "ft"
UTM_ZONE = 11
ZSCORE_MAX = 3.0
STUDY_TOP_FRACTION = 0.25
STUDY_MAX_DEPTH_M = 5.0
