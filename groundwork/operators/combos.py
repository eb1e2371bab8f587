"""Contaminant-combination mining (J8, J9, E13–E15) as mask aggregation.

The reference re-scans all samples once per combination (1,816 scans for sizes 4–11 of 11 labels).
Here the data is scanned once:

1. per (well, label) count → per well: ``mask`` = labels seen at least ``min_count`` times, ``tot`` =
   rows of the well (map-side partial aggregation; skew-proof);
2. group wells by mask → at most ``2^n`` rows, however large the input;
3. each distinct mask expands to the combinations it contains (its sub-masks of the wanted sizes):
   bounded by ``2^n`` per mask, i.e. by ``4^n`` rows in total, independent of data volume;
4. ``groupBy(combo)`` sums wells and samples; an equi-join onto the full combination list keeps the
   combinations no well passes (zeros), as the reference's dict does.

A combination passes a well iff every member has ``>= min_count`` rows, i.e. combo ⊆ mask.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import MIN_COUNT
from .screen import label_bit, visit_masks


def _bit_set(mask: Column, i: Column) -> Column:
    return F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1


MAX_COMBOS = 1 << 21  # limit on the output: combinations of up to the largest size asked for


def _dedup(labels: Sequence[str], sizes: Sequence[int]) -> list[str]:
    out = list(dict.fromkeys(labels))
    hi = min(len(out), max((int(s) for s in sizes), default=0))
    if sum(math.comb(len(out), k) for k in range(hi + 1)) > MAX_COMBOS:
        raise ValueError(f"more than {MAX_COMBOS} combinations of up to {hi} of {len(out)} labels")
    return out


def _submasks(mask: Column, n: int, sizes: Sequence[int]) -> Column:
    """Array of the sub-masks of ``mask`` whose bit count is in ``sizes``, built up bit by bit (no other masks
    than those of at most the largest size are ever made)."""
    hi = max(sizes)
    bits = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _bit_set(mask, i))

    def grow(acc, i):
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
        return F.concat(acc, F.transform(F.filter(acc, lambda m: F.bit_count(m) < hi), lambda m: m.bitwiseOR(bit)))

    every = F.aggregate(bits, F.array(F.lit(0).cast("bigint")), grow)
    wanted = F.array(*[F.lit(int(s)) for s in sizes])
    return F.filter(every, lambda m: F.array_contains(wanted, F.bit_count(m)))


def combo_text(members: Column) -> Column:
    """``"['A', 'B']"`` from an array of names, sorted (the reference's ``str(sorted(c))``)."""
    quoted = F.transform(F.array_sort(members), lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def mask_members(mask: Column, labels: Sequence[str]) -> Column:
    """Array of the labels whose bit is set in ``mask``, in list order."""
    arr = F.array(*[F.lit(x) for x in labels])
    return F.filter(arr, lambda x, i: _bit_set(mask, i))


def mask_indexes(mask: Column, n: int) -> Column:
    """Sorted 0-based positions of the set bits (the combination's index tuple)."""
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _bit_set(mask, i))


def _describe(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    n = len(labels)
    return df.withColumn("c_num", F.bit_count("combo_mask").cast("bigint")).withColumn(
        "contaminants", combo_text(mask_members(F.col("combo_mask"), labels))
    ).withColumn("idx", mask_indexes(F.col("combo_mask"), n))


def combinations_table(spark: SparkSession, labels: Sequence[str], sizes: Sequence[int],
                       groups: DataFrame | None = None) -> DataFrame:
    """Every combination of ``labels`` with a size in ``sizes``: ``combo_mask, c_num, contaminants, idx``.

    With ``groups`` (distinct group-key rows) the list is repeated per group by exploding a generated
    array on each group row — no cross join.
    """
    labels = _dedup(labels, sizes)
    n = len(labels)
    sizes = sorted({int(s) for s in sizes if 0 < int(s) <= n})
    base = groups if groups is not None else spark.range(1).select()
    full = F.lit((1 << n) - 1).cast("bigint")
    out = base.select("*", F.explode(_submasks(full, n, sizes)).alias("combo_mask"))
    return _describe(out, labels)


def _expand_submasks(groups: DataFrame, n: int, sizes: Sequence[int], value_cols: Sequence[str],
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """For each (mask, values) row emit one row per sub-mask whose size is in ``sizes``, then sum values
    per (group, sub-mask)."""
    exploded = groups.filter(F.bit_count("mask") >= min(sizes)).select(
        *group_cols, F.explode(_submasks(F.col("mask"), n, sizes)).alias("combo_mask"), *value_cols
    )
    return exploded.groupBy(*group_cols, "combo_mask").agg(*[F.sum(c).alias(c) for c in value_cols])


def well_masks(df: DataFrame, labels: Sequence[str], min_count: int = MIN_COUNT,
               group_cols: Sequence[str] = (), wells: DataFrame | None = None) -> DataFrame:
    """Distinct qualifying-label masks per group: ``<group_cols>, mask, wells, samples`` (≤ 2^n rows per group).

    One aggregate per well with a conditional count per label (partial per task, so a hot well costs one
    row a task). ``wells`` (``wid``, one row per well) restricts to those wells, after the aggregate.
    """
    labels = list(dict.fromkeys(labels))
    g = list(group_cols)
    counts = [F.count_if(F.col("parlabel") == x).alias(f"_n{i}") for i, x in enumerate(labels)]
    per_well = df.groupBy(*g, "wid").agg(*counts)
    if wells is not None:
        per_well = per_well.join(wells.select("wid"), "wid")
    mask, tot = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for i in range(len(labels)):
        mask = mask + F.when(F.col(f"_n{i}") >= min_count, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
        tot = tot + F.col(f"_n{i}")
    per_well = per_well.select(*g, mask.alias("mask"), tot.alias("tot"))
    return per_well.groupBy(*g, "mask").agg(F.count(F.lit(1)).alias("wells"), F.sum("tot").alias("samples"))


def combo_stats(
    df: DataFrame,
    labels: Sequence[str],
    sizes: Sequence[int] = range(4, 12),
    min_count: int = MIN_COUNT,
    group_cols: Sequence[str] = (),
    since: str | None = None,
    classes: Sequence[str] | None = None,
    wells: DataFrame | None = None,
) -> DataFrame:
    """Per combination: wells where every member has ``>= min_count`` rows, and all rows of those wells
    (E13). ``df`` is the sample table; ``since`` / ``classes`` apply the date and well-class filters and
    rows of other labels are dropped first (as the reference's pre-filters). With ``wells`` (one row per
    well: ``wid, field_pt_class``) the class filter and the inner join are made per well, after counting,
    so ``df`` needs no location columns. ``group_cols`` (e.g. ``['area']``) mines every group separately.

    Columns: ``<group_cols>, contaminants`` (sorted text), ``wells``, ``samples``, ``c_num``.
    """
    labels = _dedup(labels, sizes)
    if since is not None:
        df = df.filter(F.col("logdate") >= F.lit(since).cast("date"))
    if classes:
        in_class = F.col("field_pt_class").isin(list(classes))
        df, wells = (df.filter(in_class), None) if wells is None else (df, wells.filter(in_class))
    df = df.filter(F.col("parlabel").isin(labels))
    spark = df.sparkSession
    g = list(group_cols)
    sizes = sorted({int(s) for s in sizes if 0 < int(s) <= len(labels)})
    masks = well_masks(df, labels, min_count, g, wells)
    sums = _expand_submasks(masks, len(labels), sizes, ["wells", "samples"], g)
    groups = masks.select(*g).distinct() if g else None
    combos = combinations_table(spark, labels, sizes, groups)
    out = combos.join(sums, [*g, "combo_mask"], "left")
    return out.select(
        *g,
        "contaminants",
        F.coalesce(F.col("wells"), F.lit(0)).cast("bigint").alias("wells"),
        F.coalesce(F.col("samples"), F.lit(0)).cast("bigint").alias("samples"),
        "c_num",
    )


def by_wells(stats: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """The combination table in the order of its wells, most first (G2); ties by combination. At most
    ``MAX_COMBOS`` rows a group."""
    return stats.orderBy(*group_cols, F.col("wells").desc(), "contaminants")


def combo_max(stats: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Rows of each combination size holding both the size's maximum wells and maximum samples (D13);
    a size whose maxima sit on different rows yields nothing."""
    g = list(group_cols)
    m = stats.groupBy(*g, "c_num").agg(F.max("wells").alias("wells"), F.max("samples").alias("samples"))
    return stats.join(m, [*g, "c_num", "wells", "samples"], "inner").select(*g, "contaminants", "wells", "samples", "c_num")


def combo_groups(stats: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per size, the maximum of every column independently."""
    return stats.groupBy(*group_cols, "c_num").agg(
        F.max("contaminants").alias("contaminants"), F.max("wells").alias("wells"), F.max("samples").alias("samples")
    )


def visit_combo_support(df: DataFrame, labels: Sequence[str], size: int) -> DataFrame:
    """Per ``size``-combination of ``labels``: number of visits (well, date) holding every member.

    Columns: ``contaminants``, ``idx`` (index tuple, for ordering), ``n``.
    """
    labels = _dedup(labels, [size])
    spark = df.sparkSession
    masks = visit_masks(df.filter(F.col("parlabel").isin(labels)), labels)
    groups = masks.groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    sums = _expand_submasks(groups, len(labels), [size], ["n"])
    combos = combinations_table(spark, labels, [size])
    out = combos.join(sums, "combo_mask", "left")
    return out.select("contaminants", "idx", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def visit_combo_best(support: DataFrame) -> DataFrame:
    """The largest support and its combination; ties go to the first combination in enumeration order
    (E15). A top-1 over at most C(n, k) rows."""
    return support.orderBy(F.col("n").desc(), F.col("idx").asc()).limit(1).select("contaminants", "n")
