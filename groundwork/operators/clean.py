"""Union, required-column checks and ordered keep-first de-duplication.

Keep-first is a ``row_number() = 1`` window. Spark plans it as a *partial* ``WindowGroupLimit`` before
the shuffle and a final one after it, so a hot key (one well/date/label holding a third of the rows) is
cut to one row per map task before anything moves: the shuffle carries at most one row per key per
input partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import gid, sid

DEFAULT_ORDER = ("source_rank", "path", "line_no")
SAMPLE_REQUIRED = ("wid", "logdate", "parlabel", "parval")
LOCATION_REQUIRED = ("wid", "latitude", "longitude")
DTW_REQUIRED = ("wid", "dtw", "logdate")


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by column name; columns missing from a frame become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows missing any of ``cols``."""
    return df.dropna(subset=list(cols))


def _order_cols(df: DataFrame, order: Sequence[str | Column]) -> list[Column]:
    out = []
    for o in order:
        if isinstance(o, str):
            if o in df.columns:
                out.append(F.col(o).asc_nulls_last())
        else:
            out.append(o)
    return out


def keep_first(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column] = DEFAULT_ORDER,
    first: Sequence[Column] = (),
    n: int = 1,
) -> DataFrame:
    """Keep the first ``n`` rows of every ``keys`` group under ``first`` then ``order``.

    ``first`` are the leading sort expressions (e.g. value descending); ``order`` gives the ingest order
    used to break ties (columns absent from ``df`` are skipped). Null keys form one group, as a pandas
    ``drop_duplicates`` does.
    """
    w = Window.partitionBy(*keys).orderBy(*first, *_order_cols(df, order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def flag_first(
    df: DataFrame,
    keys: Sequence[str],
    sort_key: Column,
    eligible: Column | None = None,
    flag: str = "_kept",
) -> DataFrame:
    """Mark (instead of filter) the first row of every ``keys`` group: the eligible row with the smallest
    ``sort_key`` (a struct giving a total order). Lets a report count every stage in one pass.

    Skew-safe: the winning key per group is a ``min`` aggregate (partial per task, so a group holding a
    third of all rows costs one partial row per task) joined back on the keys (null-safe), where AQE
    can split a hot key's partition. Ineligible rows never win.
    """
    d = df.withColumn("_sk", sort_key).withColumn(
        "_el", F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True)
    )
    win = d.filter(F.col("_el")).groupBy(*keys).agg(F.min("_sk").alias("_win"))
    win = win.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_win")
    cond = [d[k].eqNullSafe(win[f"_k_{k}"]) for k in keys]
    out = d.join(win, cond, "left").drop(*[f"_k_{k}" for k in keys])
    out = out.withColumn(flag, F.col("_el") & F.coalesce(F.col("_sk") == F.col("_win"), F.lit(False)))
    return out.drop("_sk", "_el", "_win")


def clean_samples(raw: DataFrame, order: Sequence[str] = DEFAULT_ORDER, with_ids: bool = True) -> DataFrame:
    """One row per sample id (well, date, label), keeping the largest value.

    Required columns are checked first; ``logdate`` must already be a DATE (unparseable text is NULL
    from ingest, so those rows drop here, as after the reference's dedup).
    """
    df = require(raw, SAMPLE_REQUIRED)
    df = keep_first(df, ["wid", "logdate", "parlabel"], order, first=[F.col("parval").desc_nulls_last()])
    if with_ids:
        df = df.withColumn("gid", gid()).withColumn("sid", sid())
    return df


def dedup_locations(loc: DataFrame, order: Sequence[str] = DEFAULT_ORDER, normalize_wid: bool = False,
                    source_order: Sequence[str] | None = None) -> DataFrame:
    """One row per well, first by provider rank then ingest order (F2).

    ``source_order`` (e.g. ``['gama', 'geotracker']``, the scoring job's precedence) ranks providers by
    the ``source`` column instead of ``source_rank``. ``normalize_wid`` strips spaces from every id (the
    reference strips only some providers, so ids with spaces never join; pass True to fix that).
    """
    df = loc
    if normalize_wid:
        df = df.withColumn("wid", F.replace(F.col("wid"), F.lit(" "), F.lit("")))
    df = require(df, LOCATION_REQUIRED)
    if source_order:
        rank = F.array_position(F.array(*[F.lit(x) for x in source_order]), F.col("source"))
        df = df.withColumn("_src_rank", F.when(rank > 0, rank).otherwise(F.lit(len(source_order) + 1)))
        order = ["_src_rank", *[o for o in order if o != "source_rank"]]
        return keep_first(df, ["wid"], order).drop("_src_rank")
    return keep_first(df, ["wid"], order)


def head_per_group(df: DataFrame, keys: Sequence[str], n: int = 5, order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """First ``n`` rows of each group in ingest order."""
    return keep_first(df, keys, order, n=n)
