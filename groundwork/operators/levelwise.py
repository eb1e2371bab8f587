"""Level-wise mining of label combinations, for vocabularies of any size.

``combos`` answers for every combination of a short list, so its work and its result grow with ``2^n``. Here a least
support bounds both: a combination of ``k`` labels is only counted where all its parts of ``k - 1`` labels reached
the support (no combination holds more wells than its parts do).

1. Units (wells, visits) with equal label sets become one row with their number (``label_sets``).
2. Each level keeps rows ``combo, rest``: the combination and the labels behind it, in name order, that may still follow in the
   same sets. Rows that became equal are merged, so a level never holds a row per unit.
3. ``groupBy(combo)`` gives the supports. From the combinations that reached it, the next level's candidates are made:
   those that share all but their last label, if each of their parts reached the support.
4. Rows go on with the labels that are candidates behind their combination, and ``rest`` loses all others.

Every level is written to the shared checkpoint folder, so lineage stays short and a lost executor costs one level.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import MIN_COUNT
from ..session import ensure_checkpoint_dir
from .combos import combo_text
from .joins import splittable_join


def label_sets(
    df: DataFrame,
    keys: Sequence[str] = ("wid",),
    labels: Sequence[str] | None = None,
    min_count: int = MIN_COUNT,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """``<group_cols>, members, units, samples``: each distinct set of labels that a unit (``keys``: a well, or a visit by
    well and date) holds at least ``min_count`` times, the units that hold it and all their rows.

    ``labels`` restricts the rows first (all labels otherwise); rows without a label or without a key are left out.
    One array per unit, no longer than the vocabulary.
    """
    g, keys = list(group_cols), list(keys)
    df = df.filter(F.col("parlabel").isNotNull())
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    if labels is not None:
        df = df.filter(F.col("parlabel").isin(list(dict.fromkeys(labels))))
    counts = df.groupBy(*g, *keys, "parlabel").agg(F.count(F.lit(1)).alias("_n"))
    member = F.when(F.col("_n") >= min_count, F.col("parlabel"))
    per_unit = counts.groupBy(*g, *keys).agg(F.sort_array(F.collect_list(member)).alias("members"), F.sum("_n").alias("_tot"))
    return per_unit.groupBy(*g, "members").agg(F.count(F.lit(1)).alias("units"), F.sum("_tot").alias("samples"))


def _candidates(frequent: DataFrame, g: Sequence[str], size: int) -> DataFrame:
    """``<g>, combo, allowed``: per combination of ``size`` labels those labels that may follow, each part of the longer
    combination being frequent. Arrays are no longer than the vocabulary."""
    head, last = F.slice("combo", 1, size - 1), F.element_at("combo", -1)
    f = frequent.select(*g, "combo", head.alias("_head"), last.alias("_last"))
    lasts = f.groupBy(*g, "_head").agg(F.sort_array(F.collect_list("_last")).alias("_lasts"))
    longer = splittable_join(f, lasts, [*g, "_head"]).select(
        *g, "combo", F.explode(F.filter("_lasts", lambda x: x > F.col("_last"))).alias("_next")
    )
    if size > 1:
        # the two parts without one of the last two labels are frequent by construction; the others are looked up
        parts = F.transform(
            F.sequence(F.lit(1), F.lit(size - 1)),
            lambda i: F.concat(F.filter("combo", lambda x, j: j != i - 1), F.array("_next")),
        )
        checked = longer.select(*g, "combo", "_next", F.explode(parts).alias("_part"))
        known = frequent.select(*g, F.col("combo").alias("_part"))
        longer = (
            splittable_join(checked, known, [*g, "_part"])
            .groupBy(*g, "combo", "_next")
            .agg(F.count(F.lit(1)).alias("_k"))
            .filter(F.col("_k") == size - 1)
        )
    return longer.groupBy(*g, "combo").agg(F.sort_array(F.collect_list("_next")).alias("allowed"))


def frequent_combos(
    sets: DataFrame,
    min_support: int,
    sizes: Sequence[int] | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Combinations that at least ``min_support`` units hold, from ``label_sets`` rows.

    Columns ``<group_cols>, contaminants`` (sorted text), ``members`` (sorted array), ``units, samples`` (all rows of those
    units), ``c_num``. ``sizes`` are the sizes to report (all, if not given); smaller ones are mined on the way. Groups
    are compared as Spark joins compare, so fill a NULL group first. Combinations that no unit holds are not listed: use
    ``combos.combo_stats`` where zeros of a short list are wanted. There is no limit on labels or combinations; how many
    are found, and the work, depend on the support. Starts jobs for every level.
    """
    if min_support < 1:
        raise ValueError("min_support is at least 1")
    g = list(group_cols)
    wanted = None if sizes is None else sorted({int(s) for s in sizes if int(s) > 0})
    spark = sets.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/levelwise-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    totals = [F.sum("units").alias("units"), F.sum("samples").alias("samples")]
    rows = sets.select(*g, F.array().cast("array<string>").alias("combo"), F.col("members").alias("rest"), "units", "samples")
    levels: list[DataFrame] = []
    size = 0
    while wanted is None or (wanted and size < wanted[-1]):
        size += 1
        step = rows.select(
            *g, "combo", F.explode("rest").alias("_label"), "rest", "units", "samples"
        ).select(
            *g, F.concat("combo", F.array("_label")).alias("combo"),
            F.filter("rest", lambda x: x > F.col("_label")).alias("rest"), "units", "samples",
        )
        rows = written(step.groupBy(*g, "combo", "rest").agg(*totals), f"rows-{size}")
        frequent = rows.groupBy(*g, "combo").agg(*totals).filter(F.col("units") >= min_support)
        frequent = written(frequent, f"frequent-{size}")
        if frequent.isEmpty():
            break
        levels.append(frequent)
        if wanted is not None and size == wanted[-1]:
            break
        rows = splittable_join(rows, _candidates(frequent, g, size), [*g, "combo"]).withColumn("rest", F.array_intersect("rest", "allowed"))
        rows = rows.filter(F.size("rest") > 0).drop("allowed")
    if wanted is not None:
        levels = [f for k, f in enumerate(levels, 1) if k in wanted]
    if not levels:
        levels = [rows.select(*g, "combo", "units", "samples").limit(0)]
    found = levels[0]
    for f in levels[1:]:
        found = found.unionByName(f)
    return found.select(
        *g, combo_text(F.col("combo")).alias("contaminants"), F.col("combo").alias("members"),
        F.col("units").cast("bigint").alias("units"), F.col("samples").cast("bigint").alias("samples"),
        F.size("combo").cast("bigint").alias("c_num"),
    )
