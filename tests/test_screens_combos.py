import datetime as dt
import itertools
from collections import Counter


from groundwork import operators as op
from tests.conftest import SF001, rows

D = dt.date(2015, 3, 2)
OLD = dt.date(2010, 1, 1)


def test_detect_filter(spark):
    df = spark.createDataFrame(
        [("F1", "=", 5.0, 1.0), ("F2", None, 5.0, 1.0), ("F3", "<", 5.0, 1.0), ("F4", "=", 0.0, -1.0),
         ("F5", "=", 1.0, 1.0), ("F6", "=", 5.0, None)], "id string, parvq string, parval double, repdl double")
    assert rows(op.detects(df), "id") == [("F1",), ("F2",)]


def _counts(spark, wells):
    data = []
    for wid, counts in wells.items():
        for lab, n, date in counts:
            data += [(wid, date, lab, 1.0, "MW")] * n
    return spark.createDataFrame(data, "wid string, logdate date, parlabel string, parval double, field_pt_class string")


def test_strict_and_relaxed_screens(spark):
    wells = {
        "S1": [("A", 4, D), ("B", 4, D)], "S2": [("A", 9, D), ("B", 3, D)], "S3": [("A", 4, D)],
        "S4": [("A", 4, D), ("B", 4, D), ("C", 1, D)], "S5": [("A", 4, D), ("B", 3, D), ("B", 1, OLD)],
    }
    df = _counts(spark, wells)
    strict = op.spec_wells(df, ["A", "B"], since="2012-01-01")
    relaxed = op.spec_wells_relaxed(df, ["A", "B"], min_labels=1, since="2012-01-01")
    assert sorted({r.wid for r in strict.collect()}) == ["S1", "S4"]
    assert sorted({r.wid for r in relaxed.collect()}) == ["S1", "S3", "S4"]
    assert strict.filter("parlabel = 'C'").count() == 0


def test_combination_fixture(spark):
    df = _counts(spark, {"w1": [("A", 4, D), ("B", 4, D), ("C", 1, D)], "w2": [("A", 4, D), ("B", 5, D), ("C", 4, D)]})
    st = {r.contaminants: (r.wells, r.samples) for r in op.combo_stats(df, ["A", "B", "C"], [1, 2, 3]).collect()}
    for c in ["['A']", "['B']", "['A', 'B']"]:
        assert st[c] == (2, 22)
    for c in ["['C']", "['A', 'C']", "['B', 'C']", "['A', 'B', 'C']"]:
        assert st[c] == (1, 13)
    mx = op.combo_max(op.combo_stats(df, ["A", "B", "C"], [1, 2, 3]))
    assert rows(mx, "c_num", "contaminants") == [(1, "['A']"), (1, "['B']"), (2, "['A', 'B']"), (3, "['A', 'B', 'C']")]
    df2 = _counts(spark, {"w1": [("A", 4, D)], "w2": [("A", 4, D)], "w3": [("B", 20, D)]})
    assert op.combo_max(op.combo_stats(df2, ["A", "B"], [1])).count() == 0


def test_visits(spark):
    v = spark.createDataFrame([("w", D, x) for x in "ABC"] + [("w", OLD, x) for x in "AB"], "wid string, logdate date, parlabel string")
    assert op.visits_with_all(v, ["A", "B"]).select("logdate").distinct().count() == 2
    assert op.visits_with_all(v, ["A", "C"]).select("logdate").distinct().count() == 1
    sup = {r.contaminants: r.n for r in op.visit_combo_support(v, ["A", "B", "C"], 2).collect()}
    assert sup == {"['A', 'B']": 2, "['A', 'C']": 1, "['B', 'C']": 1}


def test_combo_stats_matches_reference_loop(spark):
    """Mask rewrite vs the reference's per-combination loop, run in pandas on sf0.001."""
    from groundwork.params import CONTS11
    from groundwork.plans import catalog as cat

    df = op.monitoring_wells(op.since_filter(cat._enriched(spark, SF001), cat.SINCE))
    df = op.contaminant_filter(df, CONTS11).select("wid", "parlabel")
    pdf = df.toPandas()
    got = {r.contaminants: (r.wells, r.samples) for r in op.combo_stats(df, CONTS11, range(4, 12)).collect()}
    assert len(got) == 1816
    for k in range(4, 12):
        for c in itertools.combinations(CONTS11, k):
            sub = pdf[pdf["parlabel"].isin(c)]
            ok = [w for w, labs in sub.groupby("wid")["parlabel"] if len(Counter(labs)) == len(c) and min(Counter(labs).values()) >= 4]
            res = pdf[pdf["wid"].isin(ok)]
            assert got[str(sorted(c))] == (res["wid"].nunique(), len(res)), c
