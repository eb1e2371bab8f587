"""Ranks by ranges against ``percent_rank``."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from groundwork.operators.ranks import percent_rank_by_ranges


def _check(df, col, **kw):
    order = F.col(col).asc() if kw.get("descending") is False else F.col(col).desc()
    want = df.withColumn("pct_rank", F.percent_rank().over(Window.orderBy(order)))
    key = lambda r: tuple(str(v) for v in r)
    got = percent_rank_by_ranges(df, col, **kw)
    assert got.columns == want.columns
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    return got


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("ranges", [2, 7, 512])
def test_equals_percent_rank_on_a_continuous_column(spark, descending, ranges):
    rng = random.Random(1)
    values = [rng.lognormvariate(0, 3) for _ in range(3000)] + [0.5] * 1500 + [None] * 40 + [float("nan"), float("nan"), float("inf"), -1.0]
    _check(spark.createDataFrame([(v,) for v in values], "v double"), "v", descending=descending, ranges=ranges)


@pytest.mark.parametrize("values", [[], [3.0], [None], [None, None], [2.0, 2.0], [1.0, None]])
def test_small_tables(spark, values):
    _check(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i long"), "v")


def test_other_types_and_no_single_window(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).cast("string").alias("v"), F.to_date(F.lit("2020-01-01")).alias("d"))
    got = _check(df, "v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_b#" in line for line in windows)
    _check(df, "d")


def test_ranges_share_the_values(spark):
    """No range holds more than a small share of the distinct values, however they are spread."""
    df = spark.range(20_000).select(F.exp(F.rand(3) * 40).alias("v"))
    from groundwork.operators import ranks

    some = df.groupBy(F.pmod(F.xxhash64("v"), F.lit(511)).alias("h")).agg(F.min_by("v", F.xxhash64("v")).alias("s"))
    s = F.lit(sorted(r.s for r in some.collect()))
    most = df.groupBy(ranks._range_of(F.col("v"), s, 512).alias("b")).count().agg(F.max("count")).first()[0]
    assert most < 20_000 * 10 / 512
