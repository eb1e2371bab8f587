"""Counts, shares, top-k and stage statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F



def label_counts(df: DataFrame, col: str = "parlabel") -> DataFrame:
    """Rows per label (E7): ``parlabel, n``."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def label_percent(df: DataFrame, col: str = "parlabel", digits: int = 4) -> DataFrame:
    """Rows per label and their share of all rows in percent, rounded half-even (E6 + B17).

    The total is a window over the grouped result — one row per distinct label (a chemical vocabulary,
    bounded) — never over the samples themselves.
    """
    counts = label_counts(df, col)
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("percent", F.bround(F.col("n") * 100.0 / total, digits))


def top_labels(df: DataFrame, n: int | None = 5, col: str = "parlabel") -> DataFrame:
    """Most frequent labels (G3): count descending, then label ascending (a top-k, not a global sort)."""
    out = label_counts(df, col).orderBy(F.col("n").desc(), F.col(col).asc())
    return out.limit(n) if n else out


def class_counts(df: DataFrame, col: str = "field_pt_class", distinct_on: str | None = None) -> DataFrame:
    """Value counts of the well class (E6); with ``distinct_on='wid'`` counts wells instead of rows."""
    agg = F.countDistinct(distinct_on) if distinct_on else F.count(F.lit(1))
    return df.groupBy(col).agg(agg.alias("n"))


def stage_counts(stages: Sequence[tuple[str, DataFrame]],
                 sid_cols: Sequence[str] = ("wid", "logdate", "parlabel")) -> DataFrame:
    """Rows, distinct sample ids and distinct wells after each named stage (E17), as one small table.

    Each stage is three plain aggregates (per sample id, per well, total) instead of DISTINCT
    aggregates: no row expansion, and a hot id or well costs one partial row per task. The union of
    the one-row results is the report. ``stage_counts_flagged`` does all stages in one pass.
    """
    parts = []
    sid = list(sid_cols)
    for i, (name, df) in enumerate(stages):
        per_sid = df.groupBy(*sid).agg(F.count(F.lit(1)).alias("_r"))
        per_well = per_sid.groupBy(sid[0]).agg(F.sum("_r").alias("_r"), F.count(F.lit(1)).alias("_s"))
        tot = per_well.agg(
            F.coalesce(F.sum("_r"), F.lit(0)).cast("bigint").alias("rows"),
            F.coalesce(F.sum("_s"), F.lit(0)).cast("bigint").alias("sids"),
            F.count(F.lit(1)).alias("wells"),
        )
        parts.append(tot.select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "rows", "sids", "wells"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stage_counts_flagged(
    df: DataFrame,
    stages: Sequence[tuple[str, Column]],
    sid_cols: Sequence[str] = ("wid", "logdate", "parlabel"),
    rows: Sequence[Column] | None = None,
) -> DataFrame:
    """Rows, distinct sample ids and distinct wells per stage from ONE pass over flagged rows.

    ``df`` holds one row per input row with a boolean condition per stage (row survives the stage).
    Three plain aggregates, all with map-side partial aggregation: per sample id (rows, present), per
    well (rows, sample ids, present), then the totals; a ``stack`` turns the single result row into
    one row per stage. Same output as ``stage_counts`` when the stage joins do not fan out rows.
    With ``rows`` (how many input rows survive each stage) ``df`` already has one row per sample id.
    """
    k = len(stages)
    sid = list(sid_cols)
    f = df.select(
        *sid,
        *[F.coalesce(c, F.lit(False)).alias(f"_s{i}") for i, (_, c) in enumerate(stages)],
        *[n.alias(f"_r{i}") for i, n in enumerate(rows or [])],
    )
    l1 = f.select(
        *sid,
        *[F.when(F.col(f"_s{i}"), F.col(f"_r{i}")).otherwise(F.lit(0)).alias(f"r{i}") for i in range(k)],
        *[F.col(f"_s{i}").alias(f"p{i}") for i in range(k)],
    ) if rows else f.groupBy(*sid).agg(
        *[F.count_if(F.col(f"_s{i}")).alias(f"r{i}") for i in range(k)],
        *[F.bool_or(F.col(f"_s{i}")).alias(f"p{i}") for i in range(k)],
    )
    l2 = l1.groupBy(sid[0]).agg(
        *[F.sum(f"r{i}").alias(f"r{i}") for i in range(k)],
        *[F.count_if(F.col(f"p{i}")).alias(f"s{i}") for i in range(k)],
        *[F.bool_or(F.col(f"p{i}")).alias(f"w{i}") for i in range(k)],
    )
    l3 = l2.agg(
        *[F.coalesce(F.sum(f"r{i}"), F.lit(0)).cast("bigint").alias(f"r{i}") for i in range(k)],
        *[F.coalesce(F.sum(f"s{i}"), F.lit(0)).cast("bigint").alias(f"s{i}") for i in range(k)],
        *[F.count_if(F.col(f"w{i}")).alias(f"w{i}") for i in range(k)],
    )
    parts = ", ".join(f"{i}, '{name}', r{i}, s{i}, w{i}" for i, (name, _) in enumerate(stages))
    return l3.selectExpr(f"stack({k}, {parts}) AS (step, stage, rows, sids, wells)")


def label_lists(df: DataFrame, keys: Sequence[str] = ("wid",), col: str = "parlabel") -> DataFrame:
    """Per group (well, or well+date): the label counter as ``map<label, count>`` and as sorted text
    ``"A:3,B:1"`` (E3/E4). The group's list is never collected whole: rows are counted per (group,
    label) first, so the collected entries per group are bounded by the label vocabulary."""
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(col).alias("k"), F.col("_n").alias("v"))))
    out = counts.groupBy(*keys).agg(entries.alias("_e"))
    return out.select(
        *keys,
        F.map_from_entries("_e").alias("counter"),
        F.array_join(F.transform("_e", lambda e: F.concat(e["k"], F.lit(":"), e["v"].cast("string"))), ",").alias("labels"),
        F.size("_e").alias("n_labels"),
    )


class StageCounts:
    """Rows per stage, counted on the way while a job writes its result: no second read.

    ``mark`` the table at each stage and use what it returns; after the job's action ``rows`` has the counts. A stage
    whose table the plan reads twice is counted twice, so mark stages of a plan that reads them once.
    """

    def __init__(self) -> None:
        self._stages: dict[str, Observation] = {}

    def mark(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """``df`` with its rows counted as ``stage``; ``metrics`` are further aggregates to take along."""
        self._stages[stage] = Observation(stage)
        return df.observe(
            self._stages[stage], F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in metrics.items()]
        )

    def metrics(self) -> dict[str, dict]:
        """What each stage counted, in the order of marking; waits for the action."""
        return {stage: dict(o.get) for stage, o in self._stages.items()}

    def rows(self) -> dict[str, int]:
        return {stage: m["rows"] for stage, m in self.metrics().items()}
