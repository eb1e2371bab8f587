"""Ranks over a whole table without a window in one task.

The values are counted first, so that a hot value is one row. Splitters cut the distinct values into ranges, a
window runs in each range, and a range starts at the sum of the counts of the ranges before it. Splitters are
one value of each hash class (the one with the least hash), so they are a sample whose choice depends on
the values alone: a retried task, or the other branch of the plan, finds the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 512


def _range_of(value: Column, splitters: Column, ranges: int) -> Column:
    """How many of the sorted splitters are at most ``value``, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(ranges.bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, s: at + F.when(F.get(splitters, at + s - 1) <= value, s).otherwise(F.lit(0))
    )


def percent_rank_by_ranges(
    df: DataFrame, col: str, out: str = "pct_rank", descending: bool = True, ranges: int = RANGES
) -> DataFrame:
    """``df`` with ``out`` = ``percent_rank() over (order by col)``, for any column that can be ordered.

    Equal values have equal ranks; a single row has rank 0. NULLs come last in descending and first in ascending
    order, NaN is the largest value. An empty table stays empty. ``out`` must not be a column of ``df``. Each range is sorted by one
    task: about ``2 / ranges`` of the distinct values on average, and ``8 / ranges`` is rarely exceeded.
    What is brought together in one task are at most ``ranges`` splitters and as many counts.
    """
    hist = df.groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_cnt"))
    some = hist.filter(F.col("_v").isNotNull()).groupBy(F.pmod(F.xxhash64("_v"), F.lit(ranges - 1)).alias("_h"))
    some = some.agg(F.min_by("_v", F.struct(F.xxhash64("_v"), "_v")).alias("_s"))
    splitters = some.agg(F.sort_array(F.collect_list("_s")).alias("_s")).scalar()
    place = _range_of(F.col("_v"), F.col("_all"), ranges)
    # NULLs form a range of their own, below all others
    hist = hist.withColumn("_all", splitters).withColumn("_b", F.when(F.col("_v").isNull(), F.lit(-1)).otherwise(place))
    hist = hist.drop("_all")

    def ahead(x: Column, y: Column) -> Column:
        return y["b"] > x["b"] if descending else y["b"] < x["b"]

    counts = hist.groupBy("_b").agg(F.sum("_cnt").alias("_t"))
    counts = counts.agg(F.collect_list(F.struct(F.col("_b").alias("b"), F.col("_t").alias("t"))).alias("_c"))
    zero = F.lit(0).cast("bigint")

    def start(x: Column) -> Column:
        before = F.aggregate(F.filter("_c", lambda y: ahead(x, y)), zero, lambda n, y: n + y["t"])
        return F.struct(x["b"].alias("b"), before.alias("n"))

    total = F.aggregate("_c", zero, lambda n, y: n + y["t"])
    known = counts.select(F.struct(F.map_from_entries(F.transform("_c", start)).alias("starts"), total.alias("n"))).scalar()

    value = F.col("_v").desc() if descending else F.col("_v").asc()
    before = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = hist.withColumn("_at", F.coalesce(F.sum("_cnt").over(before), zero))
    rank = (F.col("_at") + F.element_at(known["starts"], F.col("_b"))) / (known["n"] - 1)
    ranked = ranked.select("_v", F.when(known["n"] <= 1, F.lit(0.0)).otherwise(rank).alias(out))
    return df.join(ranked, F.col(col).eqNullSafe(F.col("_v"))).drop("_v")
