"""Independent SQL (DuckDB dialect) for every registered query, over the driver's raw tables.

Written from the adapter definitions, not generated from the Spark plans: windows for keep-first,
brute-force distance for proximity, a closed form for square polygons, ``percent_rank`` for the study
area and a mask join over ``range(2^n)`` for combinations.
"""

from __future__ import annotations

import math

from ..functions.geometry import GRS80, UTM_FALSE_EASTING, UTM_K0, utm_central_meridian
from ..params import AREAS6, CHEMS4, CONTS11, MONITORING_CLASSES, ALL_SAMPLES_SINCE
from ..sources import lookups
from ..sources.testdata import UNIT_CYCLE
from . import catalog as cat


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_q(x) for x in xs) + "]"


def _in(xs) -> str:
    return "(" + ", ".join(_q(x) for x in xs) + ")"


def _mcl_values(rows) -> str:
    vals = ", ".join(
        f"({_q(a)}, {_q(n)}, CAST({v!r} AS DOUBLE), {_q(t)}, {_q(u)})" for a, n, v, t, u in rows
    )
    return f"SELECT * FROM (VALUES {vals}) AS t(chem_abrv, chem_name, comp_conc_val, comp_conc_type, units)"


def _in_notched(s: str) -> str:
    """Inside the square, not in its upper right quarter, not in the hole (lower and left edges belong to it)."""
    x, y = f"({s}.x_m - bg.x_m)", f"({s}.y_m - bg.y_m)"
    hole = f"({x} >= -0.75 * bg.half_m AND {x} < -0.25 * bg.half_m AND {y} >= -0.75 * bg.half_m AND {y} < -0.25 * bg.half_m)"
    notch = f"({x} >= 0 AND {y} >= 0)"
    box = f"{x} >= -bg.half_m AND {x} < bg.half_m AND {y} >= -bg.half_m AND {y} < bg.half_m"
    return f"{box} AND NOT {notch} AND NOT {hole}"


SINCE = f"DATE {_q(cat.SINCE)}"
R6 = "round_even({}, 6)"

CTE = {
    "raw": f"""
SELECT 'W' || CAST(o_custkey // 2 AS VARCHAR) AS wid,
       ({_list(CONTS11)})[(l_partkey % 11) + 1] AS parlabel,
       l_quantity AS parval,
       CASE l_returnflag WHEN 'R' THEN '<' WHEN 'N' THEN '=' END AS parvq,
       round(l_discount * 100) AS repdl,
       ({_list(UNIT_CYCLE)})[(l_linenumber % 3) + 1] AS units,
       CAST(o_orderdate AS DATE) AS logdate,
       CASE WHEN l_linestatus = 'F' THEN 'geotracker' ELSE 'gama' END AS source,
       CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS source_rank,
       l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       ({_list(AREAS6)})[((o_custkey // 2) % 6) + 1] AS area
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "clean": """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY wid, logdate, parlabel
                               ORDER BY parval DESC, source_rank, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM raw WHERE wid IS NOT NULL AND logdate IS NOT NULL AND parlabel IS NOT NULL AND parval IS NOT NULL)
WHERE rn = 1""",
    "loc_raw": """
SELECT 'W' || CAST(c_custkey // 2 AS VARCHAR) AS wid,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'MW' WHEN c_mktsegment = 'BUILDING' THEN 'MONITORING'
            ELSE c_mktsegment END AS field_pt_class,
       CAST(32.5 AS DOUBLE) + CAST((c_custkey // 2) % 1000 AS DOUBLE) * CAST(0.002 AS DOUBLE) AS latitude,
       CAST(-119.5 AS DOUBLE) + CAST(((c_custkey // 2) * 7) % 1000 AS DOUBLE) * CAST(0.003 AS DOUBLE) AS longitude,
       CAST(((c_custkey // 2) * 104729) % 20000 + ((c_custkey // 2) // 1000) * 20000 AS DOUBLE) AS x_m,
       CAST(((c_custkey // 2) * 32452843) % 20000 AS DOUBLE) AS y_m,
       c_custkey % 2 AS source_rank, c_custkey AS line_no
FROM customer""",
    "locations": """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY wid ORDER BY source_rank, line_no) AS rn
  FROM loc_raw WHERE wid IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL)
WHERE rn = 1""",
    "mcl": _mcl_values(lookups.TEST_MCL_ROWS),
    "mcl_left": _mcl_values(lookups.TEST_MCL_ROWS[: cat.MCL_LEFT_ROWS]),
    "flat_mcl": _mcl_values([(lab, lab, v, "MCL", "UG/L") for lab, v in cat.SCORE_LIMITS]),
    "unit_tbl": "SELECT * FROM (VALUES "
    + ", ".join(f"({_q(u)}, CAST({c!r} AS DOUBLE))" for u, c in lookups.TEST_UNIT_ROWS)
    + ") AS t(start_unit, coef)",
    "conv": """
SELECT c.*, l.field_pt_class, l.latitude, l.longitude, m.chem_name, m.comp_conc_val, m.units AS mcl_units, u.coef,
       CASE WHEN c.units <> m.units THEN c.parval * u.coef ELSE c.parval END AS cparval
FROM clean c JOIN locations l ON c.wid = l.wid
JOIN mcl m ON c.parlabel = m.chem_abrv
JOIN unit_tbl u ON c.units = u.start_unit""",
    "enriched": """
SELECT wid, logdate, parlabel, cparval AS parval, parvq, 'UG/L' AS units, source, area, field_pt_class,
       latitude, longitude, chem_name, comp_conc_val,
       cparval > comp_conc_val AS exceedence,
       CASE WHEN comp_conc_val = 0 THEN NULL ELSE cparval / comp_conc_val END - 1 AS magnitude,
       source_rank, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, mcl_units
FROM conv""",
    "dtw_raw": """
SELECT 'W' || CAST(o_custkey // 2 AS VARCHAR) AS wid, CAST(o_orderdate AS DATE) AS logdate,
       o_totalprice / 1000 AS dtw, o_orderkey % 2 AS source_rank, o_orderkey AS line_no
FROM orders""",
    "dtw": """
SELECT wid, logdate, dtw, 'ft' AS dtw_units FROM (
  SELECT *, row_number() OVER (PARTITION BY wid, logdate ORDER BY source_rank, line_no) AS rn
  FROM dtw_raw WHERE wid IS NOT NULL AND dtw IS NOT NULL AND logdate IS NOT NULL)
WHERE rn = 1""",
    "samples_dtw": "SELECT e.*, d.dtw, d.dtw_units FROM enriched e LEFT JOIN dtw d ON e.wid = d.wid AND e.logdate = d.logdate",
    "mcl_samples": "SELECT c.*, m.chem_name, m.comp_conc_val, m.units AS mcl_units FROM clean c JOIN mcl m ON c.parlabel = m.chem_abrv",
    "det": f"""
SELECT * FROM raw WHERE (parvq IS DISTINCT FROM '<') AND parval <> 0 AND parval > repdl AND logdate >= {SINCE}""",
    "det_clean": """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY wid, logdate, parlabel
                               ORDER BY parval DESC, source_rank, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM det WHERE wid IS NOT NULL AND logdate IS NOT NULL AND parlabel IS NOT NULL AND parval IS NOT NULL)
WHERE rn = 1""",
    "ratios": """
SELECT d.*, d.parval / m.comp_conc_val AS mag FROM det_clean d JOIN flat_mcl m ON d.parlabel = m.chem_abrv
WHERE d.parval > m.comp_conc_val""",
    "gmean_wells": """
SELECT l.wid, l.x_m, l.y_m, g.mag FROM locations l JOIN (
  SELECT wid, CASE WHEN count_if(mag < 0) > 0 THEN NULL WHEN count_if(mag = 0) > 0 THEN 0.0
                   ELSE exp(avg(ln(CASE WHEN mag > 0 THEN mag END))) END AS mag
  FROM ratios GROUP BY wid) g ON l.wid = g.wid""",
    "blocks_pts": """
SELECT CAST(p_partkey AS VARCHAR) AS geoid, CAST((p_partkey * 7919) % 20000 + (p_partkey // 1000) * 20000 AS DOUBLE) AS x_m,
       CAST((p_partkey * 15485863) % 20000 AS DOUBLE) AS y_m, CAST(p_size * 10 AS DOUBLE) AS half_m
FROM part""",
    "usts_raw": """
SELECT 'S' || CAST(s_suppkey % 7 AS VARCHAR) AS Facility_I, s_name AS Name, 'A' || CAST(s_suppkey // 2 AS VARCHAR) AS Address,
       CAST(1.0 AS DOUBLE) AS Open_USTs, CAST((s_suppkey * 6007) % 20000 + (s_suppkey // 1000) * 20000 AS DOUBLE) AS x_m,
       CAST((s_suppkey * 9973) % 20000 AS DOUBLE) AS y_m, 0 AS source_rank, s_suppkey AS line_no
FROM supplier
UNION ALL
SELECT 'C' || CAST(c_custkey % 100 AS VARCHAR), c_name, 'A' || CAST(c_custkey // 3 AS VARCHAR),
       CAST(floor(c_acctbal / 1000) AS DOUBLE), CAST((c_custkey * 6007) % 20000 + (c_custkey // 1000) * 20000 AS DOUBLE),
       CAST((c_custkey * 7789) % 20000 AS DOUBLE), 1, c_custkey
FROM customer""",
    "cleanups_raw": """
SELECT CASE WHEN o_orderkey % 5 <> 0 THEN 'T' || CAST(o_orderkey % 300 AS VARCHAR) END AS GLOBAL_ID, o_orderpriority AS BUSINESS_NAME,
       o_orderstatus AS STATUS, CAST((o_orderkey * 3001) % 20000 + (o_orderkey // 1000) * 20000 AS DOUBLE) AS x_m,
       CAST((o_orderkey * 4999) % 20000 AS DOUBLE) AS y_m
FROM orders""",
    "usts_one": """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY Address
  ORDER BY Open_USTs DESC NULLS LAST, source_rank, line_no) AS rn FROM usts_raw) WHERE rn = 1""",
    "bg": """
SELECT b.*, p_retailprice % 10 AS water_table_depth_m, CAST(split_part(p_brand, '#', 2) AS INTEGER) % 2 = 0 AS is_dac
FROM blocks_pts b JOIN part ON b.geoid = CAST(p_partkey AS VARCHAR)""",
    "site_counts": f"""
SELECT bg.geoid, bg.water_table_depth_m, bg.is_dac,
       CAST((SELECT count(*) FROM usts_one s WHERE {_in_notched('s')}) AS BIGINT) AS usts,
       CAST((SELECT count(*) FROM cleanups_raw s WHERE {_in_notched('s')}) AS BIGINT) AS cleanups
FROM bg""",
    "labels": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(x)})" for i, x in enumerate(CONTS11)) + ") AS t(idx, name)",
    "combo_in": f"""
SELECT * FROM enriched WHERE logdate >= {SINCE} AND field_pt_class IN {_in(MONITORING_CLASSES)} AND parlabel IN {_in(CONTS11)}""",
    "combo_stats": f"""
SELECT ct.contaminants, CAST(count(w.wid) AS BIGINT) AS wells, CAST(coalesce(sum(w.tot), 0) AS BIGINT) AS samples,
       CAST(ct.c_num AS BIGINT) AS c_num
FROM (
  SELECT cm, c_num, '[' || string_agg('''' || name || '''', ', ' ORDER BY name) || ']' AS contaminants
  FROM (SELECT i AS cm, bit_count(i) AS c_num FROM range({1 << len(CONTS11)}) t(i)
        WHERE bit_count(i) BETWEEN {min(cat.COMBO_SIZES)} AND {max(cat.COMBO_SIZES)}) c
  JOIN labels ON (c.cm >> labels.idx) & 1 = 1
  GROUP BY cm, c_num) ct
LEFT JOIN (
  SELECT wid, sum(CASE WHEN n >= 4 THEN (CAST(1 AS BIGINT) << idx) ELSE 0 END) AS mask, sum(n) AS tot
  FROM (SELECT wid, parlabel, count(*) AS n FROM combo_in GROUP BY wid, parlabel) wl
  JOIN labels ON wl.parlabel = labels.name
  GROUP BY wid) w ON (w.mask & ct.cm) = ct.cm
GROUP BY ct.contaminants, ct.c_num""",
    "visit_labels": f"SELECT DISTINCT wid, logdate, parlabel FROM mcl_samples WHERE parlabel IN {_in(CONTS11)}",
    "visit_support": """
SELECT '[''' || array_to_string(list_sort([a.name, b.name, c.name]), ''', ''') || ''']' AS contaminants,
       a.idx AS ia, b.idx AS ib, c.idx AS ic,
       (SELECT count(*) FROM visit_labels v1
          JOIN visit_labels v2 ON v2.wid = v1.wid AND v2.logdate = v1.logdate AND v2.parlabel = b.name
          JOIN visit_labels v3 ON v3.wid = v1.wid AND v3.logdate = v1.logdate AND v3.parlabel = c.name
         WHERE v1.parlabel = a.name) AS n
FROM labels a JOIN labels b ON a.idx < b.idx JOIN labels c ON b.idx < c.idx""",
}

DEPS = {
    "clean": ["raw"],
    "locations": ["loc_raw"],
    "conv": ["clean", "locations", "mcl", "unit_tbl"],
    "enriched": ["conv"],
    "dtw": ["dtw_raw"],
    "samples_dtw": ["enriched", "dtw"],
    "mcl_samples": ["clean", "mcl"],
    "det": ["raw"],
    "det_clean": ["det"],
    "ratios": ["det_clean", "flat_mcl"],
    "gmean_wells": ["ratios", "locations"],
    "bg": ["blocks_pts"],
    "usts_one": ["usts_raw"],
    "site_counts": ["bg", "usts_one", "cleanups_raw"],
    "combo_in": ["enriched"],
    "combo_stats": ["combo_in", "labels"],
    "visit_labels": ["mcl_samples"],
    "visit_support": ["visit_labels", "labels"],
}


def _order(needs: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in needs:
        visit(n)
    return out


def sql(body: str, *needs: str) -> str:
    names = _order(list(needs))
    ctes = ",\n".join(f"{n} AS ({CTE[n].strip()})" for n in names)
    return f"WITH {ctes}\n{body.strip()}"


SAMPLE_COLS = "wid, logdate, parlabel, parval, parvq, repdl, units, source, area"
ENRICHED_COLS = (
    "wid, logdate, parlabel, parval, parvq, units, source, area, field_pt_class, latitude, longitude, "
    "chem_name, comp_conc_val, exceedence, round_even(magnitude, 6) AS magnitude"
)
WEIGHT = """CAST(CASE WHEN dist < 250 THEN 1.0 WHEN dist < 500 THEN 0.5 WHEN dist < 750 THEN 0.25
                 WHEN dist <= 1000 THEN 0.1 END AS DOUBLE)"""
GMEAN = """CASE WHEN count_if({x} < 0) > 0 THEN NULL WHEN count_if({x} = 0) > 0 THEN 0.0
               ELSE exp(avg(ln(CASE WHEN {x} > 0 THEN {x} END))) END"""
DIST_PT = "sqrt((w.x_m - b.x_m) * (w.x_m - b.x_m) + (w.y_m - b.y_m) * (w.y_m - b.y_m))"
DIST_SQ = (
    "sqrt(greatest(abs(w.x_m - b.x_m) - b.half_m, 0) * greatest(abs(w.x_m - b.x_m) - b.half_m, 0)"
    " + greatest(abs(w.y_m - b.y_m) - b.half_m, 0) * greatest(abs(w.y_m - b.y_m) - b.half_m, 0))"
)


def _strict(labels, min_count, extra_where="", src="enriched", n_cond=None) -> str:
    n_cond = f"= {len(labels)}" if n_cond is None else n_cond
    return f"""
SELECT * FROM {src} WHERE logdate >= {SINCE} AND parlabel IN {_in(labels)} {extra_where}
  AND wid IN (SELECT wid FROM (SELECT wid, parlabel, count(*) AS n FROM {src}
                               WHERE logdate >= {SINCE} AND parlabel IN {_in(labels)} {extra_where}
                               GROUP BY wid, parlabel)
              GROUP BY wid HAVING count(*) {n_cond} AND min(n) >= {min_count})"""


def _block_score(dist: str, agg: str) -> str:
    return f"""
SELECT b.geoid, round_even(coalesce(s.score, 0.0), 6) AS score
FROM blocks_pts b LEFT JOIN (
  SELECT geoid, {agg} AS score FROM (
    SELECT geoid, mag * {WEIGHT} AS adj FROM (
      SELECT b.geoid, w.mag, {dist} AS dist FROM blocks_pts b, gmean_wells w WHERE {dist} <= 1000) p
    ) q GROUP BY geoid) s ON b.geoid = s.geoid"""


def _utm_sql() -> str:
    a, f = GRS80
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n * n / 4 + n**4 / 64)
    al = [n / 2 - 2 * n * n / 3 + 5 * n**3 / 16, 13 * n * n / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    c = 2 * math.sqrt(n) / (1 + n)
    lon0 = utm_central_meridian(11)
    k = UTM_K0 * big_a
    e_terms = " + ".join(f"{al[j - 1]!r} * cos({2 * j}.0 * xi) * sinh({2 * j}.0 * eta)" for j in (1, 2, 3))
    n_terms = " + ".join(f"{al[j - 1]!r} * sin({2 * j}.0 * xi) * cosh({2 * j}.0 * eta)" for j in (1, 2, 3))
    return f"""
SELECT wid, round_even({UTM_FALSE_EASTING!r} + {k!r} * (eta + {e_terms}), 3) AS x_m,
       round_even({k!r} * (xi + {n_terms}), 3) AS y_m
FROM (
  SELECT wid, atan2(t, cos(dlam)) AS xi, atanh(sin(dlam) / sqrt(1.0 + t * t)) AS eta FROM (
    SELECT wid, dlam, sinh(atanh(sin(phi)) - {c!r} * atanh({c!r} * sin(phi))) AS t FROM (
      SELECT wid, radians(latitude) AS phi, radians(longitude - ({lon0!r})) AS dlam FROM locations)))"""


def _wqi_sql() -> str:
    cols = sorted(f"{lab}_{u}" for lab, *_r, u in lookups.TEST_MCL_ROWS if lab in CHEMS4)
    sel = ", ".join(f"round_even(avg(parval) FILTER (WHERE k = {_q(c)}), 6) AS \"{c}\"" for c in cols)
    nn = " AND ".join(f'"{c}" IS NOT NULL' for c in cols)
    return sql(
        f"""
SELECT * FROM (
  SELECT station, date, {sel} FROM (
    SELECT wid AS station, CAST(date_trunc('year', logdate) AS DATE) AS date, parlabel || '_' || mcl_units AS k, cparval AS parval
    FROM conv WHERE parlabel IN {_in(CHEMS4)})
  GROUP BY station, date)
WHERE {nn}""",
        "conv",
    )


def _stage_counts_sql() -> str:
    sidt = "count(DISTINCT coalesce(wid, 'nan') || ' ' || coalesce(strftime(logdate, '%Y-%m-%d'), 'NaT') || ' ' || coalesce(parlabel, 'nan'))"
    parts = []
    stages = [
        ("raw", "raw"), ("clean", "clean"), ("locations", "(SELECT c.* FROM clean c JOIN locations l ON c.wid = l.wid)"),
        ("mcl", "(SELECT c.* FROM clean c JOIN locations l ON c.wid = l.wid JOIN mcl m ON c.parlabel = m.chem_abrv)"),
        ("units", "conv"), ("since", f"(SELECT * FROM conv WHERE logdate >= {SINCE})"),
        ("labels", f"(SELECT * FROM conv WHERE logdate >= {SINCE} AND parlabel IN {_in(CONTS11)})"),
    ]
    for i, (name, src) in enumerate(stages):
        parts.append(
            f"SELECT {i} AS step, {_q(name)} AS stage, count(*) AS rows, {sidt} AS sids, count(DISTINCT wid) AS wells FROM {src} s"
        )
    return sql("\nUNION ALL\n".join(parts), "raw", "clean", "locations", "mcl", "conv")


def oracle_sql() -> dict[str, str]:
    dtw_cols = f"{ENRICHED_COLS}, round_even(dtw, 6) AS dtw, dtw_units"
    q = {
        "clean_samples": sql(f"SELECT {SAMPLE_COLS} FROM clean", "clean"),
        "make_ids": sql(
            "SELECT wid, logdate, parlabel, coalesce(wid, 'nan') || ' ' || coalesce(strftime(logdate, '%Y-%m-%d'), 'NaT')"
            " || ' ' || coalesce(parlabel, 'nan') AS sid FROM clean",
            "clean",
        ),
        "value_rank": sql(
            "SELECT wid, logdate, parlabel, round_even(parval, 6) AS parval, "
            "round_even(percent_rank() OVER (ORDER BY parval DESC NULLS LAST), 6) AS pct_rank FROM raw",
            "raw",
        ),
        "load_detects": sql(f"SELECT {SAMPLE_COLS} FROM det", "det"),
        "head_per_group": sql(
            f"SELECT {SAMPLE_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY wid, logdate ORDER BY source_rank, "
            "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM raw) WHERE rn <= 5",
            "raw",
        ),
        "dedup_locations": sql("SELECT wid, field_pt_class, latitude, longitude, x_m, y_m FROM locations", "locations"),
        "join_locations": sql(
            f"SELECT c.{SAMPLE_COLS.replace(', ', ', c.')}, l.field_pt_class, l.latitude, l.longitude "
            "FROM clean c JOIN locations l ON c.wid = l.wid",
            "clean", "locations",
        ),
        "join_mcl": sql(f"SELECT {SAMPLE_COLS}, chem_name, comp_conc_val, mcl_units FROM mcl_samples", "mcl_samples"),
        "join_mcl_left": sql(
            f"SELECT c.{SAMPLE_COLS.replace(', ', ', c.')}, m.chem_name, m.comp_conc_val, m.units AS mcl_units "
            "FROM clean c LEFT JOIN mcl_left m ON c.parlabel = m.chem_abrv",
            "clean", "mcl_left",
        ),
        "convert_units": sql(
            "SELECT c.wid, c.logdate, c.parlabel, round_even(CASE WHEN c.units <> m.units THEN c.parval * u.coef "
            "ELSE c.parval END, 6) AS parval, 'UG/L' AS units, m.units AS mcl_units, u.coef "
            "FROM clean c JOIN mcl m ON c.parlabel = m.chem_abrv JOIN unit_tbl u ON c.units = u.start_unit",
            "clean", "mcl", "unit_tbl",
        ),
        "enrich_samples": sql(f"SELECT {ENRICHED_COLS} FROM enriched", "enriched"),
        "all_samples": sql(
            f"SELECT {ENRICHED_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY wid, logdate, parlabel ORDER BY "
            "source_rank, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn2 FROM enriched) "
            f"WHERE rn2 = 1 AND logdate >= DATE {_q(ALL_SAMPLES_SINCE)} AND parlabel IN {_in(CONTS11)}",
            "enriched",
        ),
        "monitoring_wells": sql(
            f"SELECT {ENRICHED_COLS} FROM enriched WHERE logdate >= {SINCE} AND field_pt_class IN {_in(MONITORING_CLASSES)}",
            "enriched",
        ),
        "spec_wells_11": sql(f"SELECT {ENRICHED_COLS} FROM ({_strict(CONTS11, 4)})", "enriched"),
        "spec_wells_relaxed": sql(
            f"SELECT {ENRICHED_COLS} FROM ({_strict(CONTS11, cat.RELAXED_MIN_COUNT, n_cond=f'>= {len(CONTS11) / 2!r}')})",
            "enriched",
        ),
        "spec_wells_mw4": sql(
            f"SELECT {ENRICHED_COLS} FROM ({_strict(CHEMS4, 4, f'AND field_pt_class IN {_in(MONITORING_CLASSES)}')})",
            "enriched",
        ),
        "spec_wells_dtw": sql(
            f"SELECT {dtw_cols} FROM ({_strict(CHEMS4, cat.DTW_MIN_COUNT, 'AND dtw IS NOT NULL', 'samples_dtw')})",
            "samples_dtw",
        ),
        "dtw_union": sql("SELECT wid, logdate, round_even(dtw, 6) AS dtw, dtw_units FROM dtw", "dtw"),
        "samples_dtw": sql(f"SELECT {dtw_cols} FROM samples_dtw", "samples_dtw"),
        "join_dtw_inner": sql(
            "SELECT wid, logdate, parlabel, parval, units, latitude, longitude, round_even(dtw, 6) AS dtw, dtw_units "
            "FROM samples_dtw WHERE dtw IS NOT NULL",
            "samples_dtw",
        ),
        "all_dtw": sql(
            "SELECT wid, logdate, parlabel, parval, parvq, units, latitude, longitude, chem_name, round_even(dtw, 6) AS dtw, "
            f"dtw_units FROM samples_dtw WHERE dtw IS NOT NULL AND field_pt_class IN {_in(MONITORING_CLASSES)} "
            f"AND parlabel IN {_in(CONTS11)}",
            "samples_dtw",
        ),
        "dtw_coverage": sql(
            f"""
SELECT samples, samples_dtw, round_even(CAST(samples_dtw AS DOUBLE) * 100.0 / samples, 2) AS samples_pct,
       wells, wells_dtw, round_even(CAST(wells_dtw AS DOUBLE) * 100.0 / wells, 2) AS wells_pct
FROM (SELECT count(*) AS samples, count(d.dtw) AS samples_dtw, count(DISTINCT s.wid) AS wells,
             count(DISTINCT CASE WHEN d.dtw IS NOT NULL THEN s.wid END) AS wells_dtw
      FROM ({_strict(CHEMS4, 4)}) s LEFT JOIN dtw d ON s.wid = d.wid AND s.logdate = d.logdate)""",
            "enriched", "dtw",
        ),
        "visits_with_all": sql(
            f"SELECT {SAMPLE_COLS} FROM mcl_samples WHERE (wid, logdate) IN (SELECT wid, logdate FROM mcl_samples "
            f"WHERE parlabel IN {_in(cat.VISIT_LABELS)} GROUP BY wid, logdate "
            f"HAVING count(DISTINCT parlabel) = {len(cat.VISIT_LABELS)})",
            "mcl_samples",
        ),
        "visit_combo_support": sql("SELECT contaminants, CAST(n AS BIGINT) AS n FROM visit_support", "visit_support"),
        "visit_combo_best": sql(
            "SELECT contaminants, CAST(n AS BIGINT) AS n FROM visit_support ORDER BY n DESC, ia, ib, ic LIMIT 1",
            "visit_support",
        ),
        "combo_stats": sql("SELECT * FROM combo_stats", "combo_stats"),
        "combo_max": sql(
            "SELECT s.contaminants, s.wells, s.samples, s.c_num FROM combo_stats s JOIN (SELECT c_num, max(wells) AS mw, "
            "max(samples) AS ms FROM combo_stats GROUP BY c_num) g ON s.c_num = g.c_num AND s.wells = g.mw AND s.samples = g.ms",
            "combo_stats",
        ),
        "combo_groups": sql(
            "SELECT c_num, max(contaminants) AS contaminants, max(wells) AS wells, max(samples) AS samples "
            "FROM combo_stats GROUP BY c_num",
            "combo_stats",
        ),
        "frequent_combos": sql(
            f"""
SELECT '[' || (SELECT string_agg('''' || name || '''', ', ' ORDER BY name) FROM labels WHERE (c.i >> idx) & 1 = 1) || ']' AS contaminants,
       CAST(count(*) AS BIGINT) AS wells, CAST(sum(w.tot) AS BIGINT) AS samples, CAST(bit_count(c.i) AS BIGINT) AS c_num
FROM range(1, {1 << len(CONTS11)}) c(i)
JOIN (SELECT wid, sum(CASE WHEN n >= {cat.FREQUENT_MIN_COUNT} THEN (CAST(1 AS BIGINT) << idx) ELSE 0 END) AS mask, sum(n) AS tot
      FROM (SELECT wid, parlabel, count(*) AS n FROM enriched WHERE logdate >= {SINCE} GROUP BY wid, parlabel) wl
      JOIN labels ON wl.parlabel = labels.name GROUP BY wid) w ON (w.mask & c.i) = c.i
GROUP BY c.i HAVING count(*) >= {cat.FREQUENT_MIN_WELLS}""",
            "enriched", "labels",
        ),
        "label_counts": sql(f"SELECT parlabel, count(*) AS n FROM clean WHERE parlabel IN {_in(CONTS11)} GROUP BY parlabel", "clean"),
        "label_percent": sql(
            "SELECT parlabel, n, round_even(CAST(n AS DOUBLE) * 100.0 / sum(n) OVER (), 4) AS percent "
            "FROM (SELECT parlabel, count(*) AS n FROM enriched GROUP BY parlabel)",
            "enriched",
        ),
        "top_labels": sql(
            f"SELECT parlabel, count(*) AS n FROM enriched WHERE logdate >= {SINCE} AND field_pt_class IN "
            f"{_in(MONITORING_CLASSES)} AND parlabel IN {_in(CONTS11)} GROUP BY parlabel ORDER BY n DESC, parlabel LIMIT 5",
            "enriched",
        ),
        "class_counts": sql(
            f"SELECT field_pt_class, count(*) AS n FROM ({_strict(CHEMS4, 4, f'AND field_pt_class IN {_in(MONITORING_CLASSES)}')}) "
            "GROUP BY field_pt_class",
            "enriched",
        ),
        "stage_counts": _stage_counts_sql(),
        "wqi_pivot": _wqi_sql(),
        "well_mag_mean": sql(
            "SELECT l.wid, round_even(m.mag, 6) AS mag FROM locations l JOIN (SELECT wid, avg(magnitude) AS mag "
            "FROM enriched GROUP BY wid) m ON l.wid = m.wid",
            "enriched", "locations",
        ),
        "well_mag_gmean": sql("SELECT wid, round_even(mag, 6) AS mag FROM gmean_wells", "gmean_wells"),
        "zscore_outliers": sql(
            "SELECT wid, logdate, parlabel, round_even(mag, 6) AS mag FROM ratios, "
            "(SELECT avg(mag) AS mu, stddev_pop(mag) AS sd FROM ratios) s "
            f"WHERE abs((mag - s.mu) / s.sd) <= {cat.ZSCORE_MAX_TEST!r}",
            "ratios",
        ),
        "project_utm": sql(_utm_sql(), "locations"),
        "proximity_pairs": sql(
            f"SELECT b.geoid, w.wid, round_even({DIST_PT}, 6) AS dist FROM blocks_pts b, locations w WHERE {DIST_PT} <= 1000",
            "blocks_pts", "locations",
        ),
        "proximity_pairs_adaptive": sql(
            f"SELECT b.geoid, w.wid, round_even({DIST_PT}, 6) AS dist FROM blocks_pts b, locations w WHERE {DIST_PT} <= 1000",
            "blocks_pts", "locations",
        ),
        "proximity_weight": sql(
            f"SELECT geoid, wid, {WEIGHT} AS weight FROM (SELECT b.geoid, w.wid, {DIST_PT} AS dist "
            f"FROM blocks_pts b, locations w WHERE {DIST_PT} <= 1000)",
            "blocks_pts", "locations",
        ),
        "polygon_pairs": sql(
            f"SELECT b.geoid, w.wid, round_even({DIST_SQ}, 6) AS dist FROM blocks_pts b, locations w WHERE {DIST_SQ} <= 1000",
            "blocks_pts", "locations",
        ),
        "block_score_gmean": sql(_block_score(DIST_PT, GMEAN.format(x="adj")), "blocks_pts", "gmean_wells"),
        "block_score_mean": sql(_block_score(DIST_PT, "avg(adj)"), "blocks_pts", "gmean_wells"),
        "block_score_poly": sql(_block_score(DIST_SQ, GMEAN.format(x="adj")), "blocks_pts", "gmean_wells"),
        "ust_union": sql(
            "SELECT Facility_I, Name, Address, Open_USTs FROM (SELECT *, row_number() OVER (PARTITION BY Address "
            "ORDER BY Open_USTs DESC NULLS LAST, source_rank, line_no) AS rn FROM usts_raw) WHERE rn = 1",
            "usts_raw",
        ),
        "blockgroup_site_counts": sql("SELECT geoid, usts, cleanups, usts + cleanups AS sites FROM site_counts", "site_counts"),
        "study_area": sql(
            f"""
SELECT geoid, sites, round_even(pr, 6) AS pct_rank, round_even(water_table_depth_m, 6) AS water_table_depth_m
FROM (SELECT *, usts + cleanups AS sites, percent_rank() OVER (ORDER BY usts + cleanups DESC) AS pr FROM site_counts)
WHERE pr <= {cat.STUDY_TOP_FRACTION_TEST!r} AND water_table_depth_m <= {cat.STUDY_MAX_DEPTH_TEST!r} AND is_dac""",
            "site_counts",
        ),
        "visits_at_wells": sql(
            "SELECT v.wid, v.logdate, l.field_pt_class, l.latitude, l.longitude FROM (SELECT wid, logdate FROM mcl_samples "
            f"WHERE parlabel IN {_in(cat.VISIT_LABELS)} GROUP BY wid, logdate "
            f"HAVING count(DISTINCT parlabel) = {len(cat.VISIT_LABELS)}) v JOIN locations l ON v.wid = l.wid",
            "mcl_samples", "locations",
        ),
        "sample_ids": sql(
            "SELECT wid AS gid_wid, logdate AS gid_date, wid AS sid_wid, logdate AS sid_date, parlabel AS sid_label FROM clean",
            "clean",
        ),
        "load_cleanups": sql("SELECT GLOBAL_ID, BUSINESS_NAME, STATUS, x_m, y_m FROM cleanups_raw", "cleanups_raw"),
        "missing_sources": sql(
            f"SELECT m.* FROM ({_manifest_sql()}) m WHERE file_name NOT IN (SELECT ({_list(AREAS6)})[((c_custkey // 2) % 3) + 1] || "
            "CASE WHEN c_custkey % 3 = 0 THEN 'GeoXY.zip' ELSE 'EDF.zip' END FROM customer)",
            "raw",
        ),
        "all_samples_fanout": _fanout_sql(),
        "source_manifest": sql(_manifest_sql(), "raw"),
        "make_wid": """
SELECT c_custkey,
       replace('T0 ' || CAST(c_custkey % 97 AS VARCHAR) || '-' || ('MW ' || c_mktsegment), ' ', '') AS wid,
       'T0 ' || CAST(c_custkey % 97 AS VARCHAR) || '-' || ('MW ' || c_mktsegment) AS wid_raw
FROM customer WHERE c_custkey % 13 <> 0
UNION ALL
SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey % 13 = 0""",
        "parse_logdate": """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS logdate FROM orders""",
        "exceedence_magnitude": sql(
            "SELECT wid, logdate, parlabel, parval, parval > comp_conc_val AS exceedence, "
            "round_even(CASE WHEN comp_conc_val = 0 THEN NULL ELSE parval / comp_conc_val END - 1, 6) AS magnitude FROM mcl_samples",
            "mcl_samples",
        ),
        "since_filter": sql(f"SELECT {SAMPLE_COLS} FROM clean WHERE logdate >= {SINCE}", "clean"),
        "contaminant_filter": sql(f"SELECT {SAMPLE_COLS} FROM clean WHERE parlabel IN {_in(CHEMS4)}", "clean"),
        "label_lists": sql(
            "SELECT wid, string_agg(parlabel || ':' || CAST(n AS VARCHAR), ',' ORDER BY parlabel) AS labels, "
            "CAST(count(*) AS INTEGER) AS n_labels FROM (SELECT wid, parlabel, count(*) AS n FROM enriched "
            f"WHERE logdate >= {SINCE} AND parlabel IN {_in(CONTS11)} GROUP BY wid, parlabel) GROUP BY wid",
            "enriched",
        ),
        "union_samples": sql(
            "SELECT wid, logdate, parlabel, parval, parvq, repdl, units, source, "
            "CASE WHEN source = 'gama' THEN area END AS area FROM raw",
            "raw",
        ),
    }
    return q


def _fanout_sql() -> str:
    """Limits and factors that repeat a key: of the rows they make, that of the first limit, then factor."""
    mcl = ", ".join(f"({i}, {_q(a)}, {_q(n)}, CAST({v!r} AS DOUBLE), {_q(u)})" for i, (a, n, v, _t, u) in enumerate(cat.FANOUT_MCL))
    units = ", ".join(f"({i}, {_q(u)}, CAST({c!r} AS DOUBLE))" for i, (u, c) in enumerate(cat.FANOUT_UNITS))
    return sql(
        f"""
SELECT wid, logdate, parlabel, cparval AS parval, parvq, 'UG/L' AS units, source, area, field_pt_class, latitude, longitude,
       chem_name, v AS comp_conc_val, cparval > v AS exceedence, round_even(cparval / v - 1, 6) AS magnitude
FROM (
  SELECT c.*, l.field_pt_class, l.latitude, l.longitude, m.chem_name, m.v,
         CASE WHEN c.units <> m.u THEN c.parval * f.coef ELSE c.parval END AS cparval,
         row_number() OVER (PARTITION BY c.wid, c.logdate, c.parlabel ORDER BY m.i, f.i) AS first_entry
  FROM clean c JOIN locations l ON c.wid = l.wid
  JOIN (VALUES {mcl}) m(i, lab, chem_name, v, u) ON c.parlabel = m.lab
  JOIN (VALUES {units}) f(i, start_unit, coef) ON c.units = f.start_unit)
WHERE first_entry = 1 AND logdate >= DATE {_q(ALL_SAMPLES_SINCE)} AND parlabel IN {_in(CONTS11)}""",
        "clean", "locations",
    )


def _manifest_sql() -> str:
    from ..params import EDF_SUFFIX, GAMA_DATASETS, GAMA_PREFIX, GAMA_SUFFIX, GEOXY_SUFFIX

    rows = [f"SELECT area, 'edf' AS dataset, area || {_q(EDF_SUFFIX)} AS file_name FROM a",
            f"SELECT area, 'geoxy', area || {_q(GEOXY_SUFFIX)} FROM a"]
    for ds in GAMA_DATASETS:
        rows.append(f"SELECT area, {_q(ds)}, {_q(GAMA_PREFIX + ds)} || lower(area) || {_q(GAMA_SUFFIX)} FROM a")
    return "SELECT * FROM (WITH a AS (SELECT DISTINCT area FROM raw) " + " UNION ALL ".join(rows) + ")"
