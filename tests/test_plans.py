"""Plan checks: the scale-critical operators plan as intended."""

from groundwork.plans import catalog as cat
from tests.conftest import SF001


def _plan(df):
    df.write.format("noop").mode("overwrite").save()  # let AQE finalise
    return df._jdf.queryExecution().executedPlan().toString()


def test_proximity_is_equi_join(spark):
    for q in (cat.q_proximity_pairs, cat.q_polygon_pairs, cat.q_block_score_poly, cat.q_blockgroup_site_counts):
        p = _plan(q(spark, SF001))
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p, q.__name__
        assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_combo_mining_no_nested_loop_or_python(spark):
    p = _plan(cat.q_combo_stats(spark, SF001))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
    assert "Python" not in p


def test_keep_first_has_partial_group_limit(spark):
    df = cat.q_clean_samples(spark, SF001)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p and "Partial" in p


def test_scans_are_pruned(spark):
    df = cat.q_clean_samples(spark, SF001)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in p and "l_tax" not in p  # unused lineitem columns never read
