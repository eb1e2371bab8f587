import datetime as dt

import pytest

from groundwork import operators as op
from tests.conftest import rows

D = dt.date(2015, 3, 2)


def test_label_percent(spark):
    df = spark.createDataFrame([("A",), ("A",), ("B",)], "parlabel string")
    got = {r.parlabel: r.percent for r in op.label_percent(df).collect()}
    assert got == {"A": 66.6667, "B": 33.3333}  # P1


def test_top1_tie_alphabetical(spark):
    df = spark.createDataFrame([("B",), ("A",)], "parlabel string")
    assert [r.parlabel for r in op.top_labels(df, 1).collect()] == ["A"]  # P5


def test_pivot_mean_and_dropna(spark):
    df = spark.createDataFrame(
        [("W1", D, "BZ", 2.0, "UG/L"), ("W1", D, "BZ", 4.0, "UG/L"), ("W1", D, "CD", 1.0, "UG/L"), ("W2", D, "BZ", 1.0, "UG/L")],
        "wid string, logdate date, parlabel string, parval double, mcl_units string")
    out = op.wqi_pivot(df, ["BZ_UG/L", "CD_UG/L"])
    assert rows(out) == [("W1", D, 3.0, 1.0)]  # P2, P3


def test_dtw_coverage(spark):
    df = spark.createDataFrame([("W1", 1.0), ("W1", 2.0), ("W1", 3.0), ("W2", None)], "wid string, dtw double")
    r = op.dtw_coverage(df).first()
    assert (r.samples, r.samples_dtw, r.samples_pct, r.wells, r.wells_dtw, r.wells_pct) == (4, 3, 75.0, 2, 1, 50.0)  # P4


def test_study_area_top_quarter(spark):
    df = spark.createDataFrame([(f"g{n}", n, 1.0, True) for n in range(8, 0, -1)],
                               "geoid string, sites long, water_table_depth_m double, is_dac boolean")
    out = op.study_area(df, 0.25, 5.0)
    assert rows(out, "sites") == [(7,), (8,)]
    pr = {r.sites: r.pct_rank for r in op.rank_fraction_desc(df, "sites").collect()}
    assert pr[8] == 0.0 and pr[7] == pytest.approx(1 / 7) and pr[1] == 1.0


def test_stage_counts_monotone(spark):
    from groundwork.plans import catalog as cat

    st = [r for r in cat.q_stage_counts(spark, "/root/testdata/sf0.001").orderBy("step").collect()]
    assert [s.stage for s in st][:2] == ["raw", "clean"]
    assert st[1].rows == st[1].sids  # SIDs unique after clean
    assert all(a.rows >= b.rows for a, b in zip(st[1:], st[2:]))


def test_generic_stage_counts_equal_flagged(spark):
    from groundwork.plans import catalog as cat

    d = "/root/testdata/sf0.001"
    raw = cat._raw(spark, d)
    clean = cat._clean(spark, d)
    loc = op.join_locations(clean, cat._locations(spark, d))
    generic = {r.stage: (r.rows, r.sids, r.wells) for r in op.stage_counts([("raw", raw), ("clean", clean), ("locations", loc)]).collect()}
    flagged = {r.stage: (r.rows, r.sids, r.wells) for r in cat.q_stage_counts(spark, d).collect()}
    for k in generic:
        assert generic[k] == flagged[k], k
