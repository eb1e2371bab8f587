"""Hot keys: one well holds a third of the rows and one sample id has thousands of copies."""

from collections import Counter

from pyspark.sql import functions as F

from groundwork import operators as op
from groundwork.params import CONTS11
from groundwork.sources import testdata as td
from tests.conftest import SF001


def _skewed(spark):
    raw = td.samples_raw(spark, SF001)
    # every third row moves to well W_HOT; a tenth of those also collapse onto one date
    hot = (F.col("line_no") % 3) == 0
    raw = raw.withColumn("wid", F.when(hot, F.lit("W_HOT")).otherwise(F.col("wid")))
    raw = raw.withColumn("logdate", F.when(hot & (F.col("line_no") % 10 == 0), F.lit("2000-01-01").cast("date")).otherwise(F.col("logdate")))
    return raw


def test_keep_first_on_hot_keys(spark):
    raw = _skewed(spark)
    got = op.clean_samples(raw, order=td.SAMPLE_ORDER, with_ids=False).select("wid", "logdate", "parlabel", "parval", "line_no")
    pdf = raw.select("wid", "logdate", "parlabel", "parval", "source_rank", "line_no", "line_part", "line_supp", "line_price").toPandas()
    assert (pdf.wid == "W_HOT").mean() > 0.3
    pdf = pdf.sort_values(["parval", "source_rank", "line_no", "line_part", "line_supp", "line_price"],
                          ascending=[False, True, True, True, True, True])
    exp = pdf.drop_duplicates(["wid", "logdate", "parlabel"], keep="first")
    g = sorted((r.wid, r.logdate, r.parlabel, r.parval, r.line_no) for r in got.collect())
    e = sorted((r.wid, r.logdate, r.parlabel, r.parval, r.line_no) for r in exp.itertuples())
    assert g == e


def test_screen_and_combos_on_hot_well(spark):
    clean = op.clean_samples(_skewed(spark), order=td.SAMPLE_ORDER, with_ids=False)
    pdf = clean.select("wid", "parlabel").toPandas()
    spec = op.spec_wells(clean, CONTS11, min_count=4)
    exp = {w for w, labs in pdf.groupby("wid")["parlabel"] if len(Counter(labs)) == 11 and min(Counter(labs).values()) >= 4}
    assert {r.wid for r in spec.select("wid").distinct().collect()} == exp
    assert "W_HOT" in exp
    st = {r.contaminants: (r.wells, r.samples) for r in op.combo_stats(clean, CONTS11, [11]).collect()}
    rows = pdf[pdf.wid.isin(exp)]
    assert st[str(sorted(CONTS11))] == (len(exp), len(rows))


def test_visits_on_hot_visit(spark):
    clean = op.clean_samples(_skewed(spark), order=td.SAMPLE_ORDER, with_ids=False)
    labels = ["BZ", "BZME", "EBZ"]
    got = op.visits_with_all(clean, labels).select("wid", "logdate").distinct()
    pdf = clean.select("wid", "logdate", "parlabel").toPandas()
    exp = {k for k, labs in pdf.groupby(["wid", "logdate"])["parlabel"] if set(labels) <= set(labs)}
    assert {(r.wid, r.logdate) for r in got.collect()} == exp
    assert any(w == "W_HOT" for w, _ in exp)
