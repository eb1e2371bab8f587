"""Exact duplicates by a content sort.

Rows are range-partitioned by sampled splitters over their normalised text, sorted externally inside
each partition so that equal texts are adjacent, and neighbours are compared in full (the window below
starts a new group wherever the whole normalised text changes).

* Splitters are drawn on (first ``LEAD`` characters, 64-bit hash of the whole text, piece): the driver
  samples keys of bounded length, however long the texts are, and texts with a common opening still
  spread. Equal texts have equal keys, so they meet in one partition.
* A text that alone holds more than an even share of the rows (rows / shuffle partitions) is cut into
  pieces by its id's hash; there are at most as many such texts as partitions. Each piece is sorted and
  compared like any other group, and the pieces' totals (a few rows) are put together afterwards.

The text moves through one exchange; nothing but column expressions, windows and joins is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, shared_table, shuffle_partitions, text_or_empty

LEAD = 32


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. ``keep`` ('min' or 'max') says whether the
    smallest or the largest id of a group stays. A null text counts as empty. Rows with a null id stay
    only in a group that has no other id (``keep_id`` is then null). Of rows that repeat the kept id
    exactly one has ``kept``. An empty table gives an empty result; other columns are not read.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    best = F.min if keep == "min" else F.max
    first = (lambda c: F.col(c).asc_nulls_last()) if keep == "min" else (lambda c: F.col(c).desc_nulls_last())
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(text_or_empty(text_col)).alias("norm"))
    rows = rows.withColumn("hash", F.xxhash64("norm"))

    parts = shuffle_partitions(spark)
    share = max(2, docs.count() // parts)
    crowded = rows.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > share)
    crowded = shared_table(crowded.select("hash", F.ceil(F.col("n") / share).alias("pieces")), "crowded")
    # at most rows / share texts can each hold more than `share` rows: no more than about `parts` rows
    rows = rows.join(F.broadcast(crowded), "hash", "left").withColumn(
        "piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("id"), F.col("pieces"))).otherwise(F.lit(0))
    )

    lead = F.substring("norm", 1, LEAD)
    placed = rows.withColumn("lead", lead).repartitionByRange("lead", "hash", "piece")
    group = Window.partitionBy("lead", "hash", "piece", "norm")
    in_order = group.orderBy(first("id"))
    compared = placed.select(
        "id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.col("pieces").isNotNull().alias("cut"),
        F.row_number().over(in_order).alias("place"),
        F.count("*").over(group).alias("piece_size"),
        best("id").over(group).alias("piece_keep"),
    )
    compared = shared_table(compared, "compared")

    totals = (
        compared.where(F.col("cut") & (F.col("place") == 1))
        .groupBy("text_sha256")
        .agg(F.sum("piece_size").alias("all_size"), best("piece_keep").alias("all_keep"))
    )
    size = F.coalesce(F.col("all_size"), F.col("piece_size"))
    keep_id = F.when(F.col("all_size").isNotNull(), F.col("all_keep")).otherwise(F.col("piece_keep"))
    return compared.join(F.broadcast(totals), "text_sha256", "left").select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        size.alias("group_size"),
        ((F.col("place") == 1) & F.col("id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )
