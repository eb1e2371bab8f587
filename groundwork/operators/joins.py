"""Lookup joins.

Limits, unit factors and combination lists are inline relations or small files, so Spark knows their
size in bytes when it plans and broadcasts them under ``spark.sql.autoBroadcastJoinThreshold``; beyond
it they are joined by shuffle. No hint and no counting job is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_SPREAD = "_spread"


def splittable_join(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (one row per key, of one or more columns) by an exchange of its own on both sides.

    Spark splits a hot key's partition only where both inputs of the join come straight out of an exchange made for it.
    A right side that a window or an aggregate on the key has already partitioned has none. One more key, made from
    the others, is not covered by that partitioning, so both sides are exchanged; no row is copied.
    """
    keys = [keys] if isinstance(keys, str) else keys
    spread = F.xxhash64(*keys)
    return left.withColumn(_SPREAD, spread).join(right.withColumn(_SPREAD, spread), [*keys, _SPREAD], how).drop(_SPREAD)


def with_row_no(lookup: DataFrame, name: str) -> DataFrame:
    """The lookup with its row's place in the table (``row_no``, NULL where it has none) as ``name``."""
    place = F.col("row_no") if "row_no" in lookup.columns else F.lit(None)
    return lookup.withColumn(name, place.cast("bigint"))
